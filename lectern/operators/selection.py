"""Greedy selections that relational algebra can't express: diversity under a budget, admission.

Each works on one group of bounded size (the fetched hits of a query, the
calls of one key) inside applyInPandas.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd

def mmr(hits: pd.DataFrame, k: int, trade: float, budget: int) -> pd.DataFrame:
    """Maximal marginal relevance: the best of trade * sim - (1 - trade) * (largest cosine to what is selected); an item over the budget is left out and the loop goes on."""
    hits = hits.sort_values(["sim", "idx", "chunk_id"], ascending=[False, True, True], kind="stable")
    hits = hits.drop_duplicates("chunk_id").drop_duplicates("text").reset_index(drop=True)
    vectors = np.array(hits["vec"].tolist(), float)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    nearest, taken, spent, pool = np.full(len(hits), -np.inf), [], 0, list(range(len(hits)))
    while pool and len(taken) < k:
        worth = [trade * hits["sim"][i] - (1 - trade) * (nearest[i] if taken else 0.0) for i in pool]
        at = pool.pop(int(np.argmax(worth)))
        if spent + hits["cost"][at] > budget:
            continue
        spent += hits["cost"][at]
        taken.append(at)
        nearest = np.maximum(nearest, vectors @ vectors[at])
    out = hits.iloc[taken].copy()
    out["place"] = np.arange(1, len(out) + 1)
    return out


def mmr_sources(hits: pd.DataFrame, k: int, trade: float, budget: int, prior: pd.DataFrame | None = None) -> pd.DataFrame:
    """Several sources: the cheapest item of each source first, then better ones that still fit, then diversity if every source is covered.

    prior is evidence that is there already (doc, chunk_id, text, cost): it has its share of the budget and covers its sources, and neither its
    chunks nor its texts are taken again. Diversity is measured against what is taken now.
    """
    hits = hits[hits["sim"] > 0].sort_values(["sim", "doc", "idx", "chunk_id"], ascending=[False, True, True, True], kind="stable")
    hits = hits.drop_duplicates("chunk_id").drop_duplicates(["doc", "text"])
    covered, spent = set(), 0
    every = set(hits["doc"])
    if prior is not None and len(prior):
        prior = prior.drop_duplicates("chunk_id").drop_duplicates(["doc", "text"])
        covered, spent = set(prior["doc"]), int(prior["cost"].sum())
        every |= covered
        same = pd.MultiIndex.from_frame(hits[["doc", "text"]]).isin(pd.MultiIndex.from_frame(prior[["doc", "text"]]))
        hits = hits[~hits["chunk_id"].isin(prior["chunk_id"]) & ~same]
        if spent > budget:
            raise ValueError("the evidence so far exceeds the budget")
    hits = hits.reset_index(drop=True)
    if not len(hits):
        return hits.assign(place=pd.Series(dtype=int))
    sources = sorted(set(hits["doc"]) - covered)
    base: dict[int, int] = {}
    for at in hits.sort_values(["cost", "sim", "doc", "idx", "chunk_id"], ascending=[True, False, True, True, True], kind="stable").index:
        if hits["doc"][at] in base or hits["doc"][at] in covered:
            continue
        if spent + hits["cost"][at] > budget:
            break
        base[hits["doc"][at]] = at
        spent += hits["cost"][at]
    for doc in list(base):
        for at in hits.index[hits["doc"] == doc]:
            if spent - hits["cost"][base[doc]] + hits["cost"][at] <= budget:
                spent += hits["cost"][at] - hits["cost"][base[doc]]
                base[doc] = at
                break
    taken = list(base.values())
    if len(base) == len(sources):
        vectors = np.array(hits["vec"].tolist(), float)
        vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
        pool = [i for i in hits.index if i not in taken]
        while pool and len(taken) < max(k, len(every)):
            worth = [trade * hits["sim"][i] - (1 - trade) * ((vectors[taken] @ vectors[i]).max() if taken else 0.0) for i in pool]
            at = pool.pop(int(np.argmax(worth)))
            if spent + hits["cost"][at] <= budget:
                spent += hits["cost"][at]
                taken.append(at)
    return hits.iloc[taken].assign(place=np.arange(1, len(taken) + 1))


def admit(calls: pd.DataFrame, per_minute: int, tokens_per_minute: int, per_day: int) -> pd.Series:
    """Which calls are accepted, in time order; only accepted ones fill the window, and one aged exactly 60 s still does."""
    window: deque = deque()
    used, day, today, out = 0, None, 0, []
    for at, tokens in zip(calls["second"], calls["tokens"], strict=True):
        while window and at - window[0][0] > 60:
            used -= window.popleft()[1]
        if at // 86_400 != day:
            day, today = at // 86_400, 0
        good = len(window) < per_minute and used + tokens <= tokens_per_minute and today + 1 <= per_day
        if good:
            window.append((at, tokens))
            used += tokens
            today += 1
        out.append(good)
    return pd.Series(out, index=calls.index, dtype=bool)
