"""Search results as plain dictionaries and JSON."""

from __future__ import annotations

import json
import time
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from lodestone.functions.facet_value import to_key
from lodestone.operators.search import SearchResult
from lodestone.state import encode


def _value(row) -> Any:
    return row.n if row.n is not None else row.b if row.b is not None else row.s


def response(result: SearchResult) -> dict[str, Any]:
    """hits, counts, pages, facets (value -> count, ordered), their statistics, and buckets with types and refinement."""
    began = time.time()
    spec = result.index.spec
    if result.state.page > 0:
        result.nb_hits  # which page it is depends on it  # noqa: B018
    if result.state.query:
        result.candidates  # counts the matches once  # noqa: B018
    jobs = (lambda: result.nb_hits, lambda: result.hits.collect(), lambda: sorted(result.facets.collect(), key=lambda r: (r.facet, r.position)), lambda: result.stats.collect())
    with ThreadPoolExecutor(len(jobs)) as pool:  # independent jobs, so that small ones don't wait for each other
        _, rows, found, stats = pool.map(lambda job: job(), jobs)
    hits = []
    for row in rows:
        own = {k: None if v is None else json.loads(v) for k, v in row.asDict().items() if k not in ("object_id", "score")}
        hits.append({"objectID": row.object_id, **own})
    buckets: dict[str, dict[str, Any]] = {}
    for a in spec.facets:
        if result.state.facets is None or a.key in result.state.facets:
            buckets[a.key] = {"operator": a.facet_operator, "type": a.facet_type, "buckets": []}
    for row in found:
        buckets[row.facet]["buckets"].append({"value": _value(row), "count": row["count"], "isRefined": row.is_refined})
    return {
        "hits": hits,
        "nbHits": result.nb_hits,
        "page": result.page,
        "nbPages": result.nb_pages,
        "hitsPerPage": result.hits_per_page,
        "query": result.state.query,
        "params": "&".join(f"{k}={v}" for k, v in encode(result.state).items()),
        "exhaustiveNbHits": True,
        "exhaustiveFacetsCount": True,
        "facets": {k: {to_key(b["value"]): b["count"] for b in f["buckets"]} for k, f in buckets.items() if f["buckets"]},
        "facets_stats": {r.facet: {n: r[n] for n in ("min", "max", "avg", "sum")} for r in stats},
        "facetBuckets": buckets,
        "processingTimeMS": int(1000 * (time.time() - began)),
    }


def to_json(result: SearchResult) -> str:
    return json.dumps(response(result), ensure_ascii=False)


def facet_view(result: SearchResult, path: str = "/") -> list[dict[str, Any]]:
    """What a page needs of each facet: its buckets with labels and the URLs that toggle them."""
    from lodestone.functions.labels import tree, value_label
    from lodestone.spec import HIERARCHICAL
    from lodestone.state import url

    out = []
    for key, facet in response(result)["facetBuckets"].items():
        attribute = result.index.spec.attribute(key)
        rows = [{**b, "key": to_key(b["value"]), "label": value_label(attribute, b["value"]), "url": url(path, result.state.toggled(key, b["value"]))} for b in facet["buckets"]]
        if attribute.facet_type == HIERARCHICAL:
            rows = [{**r, **{k: t[k] for k in ("depth", "parent")}} for r, t in zip(rows, tree([r["value"] for r in rows], attribute.separator))]
        out.append({"key": key, "label": attribute.label or key, "isRefined": key in result.state.refined_facets, "buckets": rows})
    return out
