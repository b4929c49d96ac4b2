"""A query over an index: text match, filters, leave-one-out counts, total order, pages."""

from __future__ import annotations

import threading
import weakref
from contextlib import suppress
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import query_tokens, word_list
from lodestone.operators.compile import Index
from lodestone.operators.facets import buckets, facet_counts, facet_stats, failures
from lodestone.operators.filters import boxes, nearest, predicates
from lodestone.operators.match import text_match
from lodestone.spec import DISTANCE, PAYLOAD, IndexSpec
from lodestone.state import QueryState


def order_keys(spec: IndexSpec, state: QueryState) -> list[Column]:
    """Sort keys that end in the object id, so that the order is total; records without a value come last either way."""
    tail = [F.col("score").desc(), F.col("object_id").asc()]
    if state.sort_by == DISTANCE and nearest(spec, state) is not None:
        return [F.col("_distance").asc_nulls_last(), F.col("object_id").asc()]
    sorting = spec.sorting(state.sort_by)
    if sorting is None:
        return tail
    key = F.col(f"s_{sorting.attribute}")
    return [key.desc_nulls_last() if sorting.direction == "desc" else key.asc_nulls_last(), *tail]


def _forget(found: DataFrame) -> None:
    """Drops kept matches, from a thread of its own: a result may go while this one is in the middle of a call to the JVM."""

    def drop() -> None:
        with suppress(Exception):  # the session may have ended
            found.unpersist()

    threading.Thread(target=drop, daemon=True).start()


@dataclass(frozen=True)
class SearchResult:
    """Lazy tables of one query; `count` and what follows from it run one job."""

    index: Index
    state: QueryState

    @cached_property
    def _checks(self) -> dict[str, Column]:
        return predicates(self.index.spec, self.state)

    @cached_property
    def _tokens(self) -> list[str]:
        return query_tokens(self.state.query, word_list(self.index.spec.stopwords))

    @cached_property
    def _scores(self) -> DataFrame | None:
        if not self._tokens:
            return None
        if self.index.postings is None:
            return self.index.records.select("object_id", F.lit(0.0).alias("score")).limit(0)
        # Found by the first job that needs them, kept for the next ones, and dropped with the result. A result that goes
        # before its jobs run leaves one job, that needs no copy. Spark broadcasts them where they turn out to be few.
        found = text_match(self.index.postings, self._tokens).persist()
        weakref.finalize(self, _forget, found).atexit = False
        return found

    @cached_property
    def candidates(self) -> DataFrame:
        """Records that match the text, with `score`."""
        if self._scores is None:
            return self.index.records.withColumn("score", F.lit(0.0))
        return self.index.records.join(self._scores, "object_id")

    @cached_property
    def matches(self) -> DataFrame:
        """All hits, in no order: the records that pass every predicate."""
        rows = self.candidates
        for check in (*boxes(self.index.spec, self.state), *self._checks.values()):
            rows = rows.where(check)
        return rows

    @cached_property
    def nb_hits(self) -> int:
        return self.matches.count()

    @property
    def hits_per_page(self) -> int:
        given = self.state.hits_per_page
        return max(1, self.index.spec.hits_per_page if given is None else given)

    @property
    def nb_pages(self) -> int:
        return -(-self.nb_hits // self.hits_per_page)

    @property
    def page(self) -> int:
        """The page asked for, or the last one; the first page needs no count."""
        return 0 if self.state.page <= 0 else min(self.state.page, max(0, self.nb_pages - 1))

    @cached_property
    def ordered(self) -> DataFrame:
        """All hits in order."""
        rows, far = self.matches, nearest(self.index.spec, self.state)
        if far is not None:
            rows = rows.withColumn("_distance", far)
        return rows.orderBy(*order_keys(self.index.spec, self.state))

    @cached_property
    def hits(self) -> DataFrame:
        """The page asked for (the last one if there are fewer): object_id, score, payload. A top-k, not a full sort."""
        own = [F.col(f"p_{a.key}").alias(a.key) for a in self.index.spec.with_role(PAYLOAD)]
        rows = self.ordered
        if self.page:
            rows = rows.offset(self.page * self.hits_per_page)
        return rows.limit(self.hits_per_page).select("object_id", "score", *own)

    @cached_property
    def counts(self) -> DataFrame:
        """Values of all facets with their counts, uncut."""
        # Refined values stay visible even if no record with them matches the text.
        every = None if self._scores is None else self.index.records
        return facet_counts(self.candidates, self.index.spec, self.state, self._checks, every)

    @cached_property
    def facets(self) -> DataFrame:
        """facet, position, value, count, is_refined, n, s, b."""
        return buckets(self.counts, self.index.spec, self.state)

    @cached_property
    def stats(self) -> DataFrame:
        """facet, min, max, avg, sum of numeric facets."""
        return facet_stats(self.candidates, self.index.spec, self.state, self._checks)

    @cached_property
    def passing(self) -> DataFrame:
        """Records with the number of predicates that they fail, for diagnosis."""
        return self.candidates.withColumn("failed", failures(self._checks))

    @property
    def first(self) -> int:
        """One-based number of the first hit on the page; 0 without hits."""
        return self.page * self.hits_per_page + 1 if self.nb_hits else 0

    @property
    def last(self) -> int:
        return min(self.nb_hits, (self.page + 1) * self.hits_per_page)

    @property
    def is_empty(self) -> bool:
        return self.nb_hits == 0


def search(index: Index, state: QueryState | dict | None = None) -> SearchResult:
    return SearchResult(index, state if isinstance(state, QueryState) else QueryState.from_dict(state or {}))
