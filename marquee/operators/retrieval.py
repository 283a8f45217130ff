"""Dense and sparse nearest neighbours by cosine."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from marquee.operators.blocks import BlockSizes, Order, best_matches

# Scores are ranked after rounding, so that equal vectors tie exactly.
DIGITS = 6
_SCHEMA = (
    "query_id bigint, id bigint, similarity_score double, hybrid_score double, "
    "score_key double, similarity_key double, vote_count double"
)
_COLUMNS = [field.split()[0] for field in _SCHEMA.split(", ")]
#: Dense vectors are short rows: larger blocks send fewer copies of them, and fewer finds of each query.
DENSE_SIZES = BlockSizes(query_rows=8192, item_rows=16384)
#: For pools of fifty and more: a query sends its whole pool for each item block, which is far more than its vector.
POOL_SIZES = BlockSizes(query_rows=8192, item_rows=65536)
#: Rows of a block at most, and blocks that many queries are cut into, where every vector is a query.
_LARGEST, _QUERY_BLOCKS = 65536, 16
#: Items whose best score stands for them all where a bound of the k-th score is sought.
RUN = 64
#: Keys are rounded scores: one that reaches a rounded score differs from it by less than this.
_ROUNDING = 2 * 10.0**-DIGITS
#: Every score but that of an item left out.
_LEAST = np.finfo(float).min
#: The columns of a search result, without its rank.
RESULT = ["query_id", "id", "similarity_score", "vote_count"]
ORDER = Order(["score_key", "similarity_key", "vote_count", "id"], [False, False, False, True])


def _best_of_block(
    scores: np.ndarray, queries: pd.DataFrame, items: pd.DataFrame, k: int, weight: float
) -> list[pd.DataFrame]:
    """The k best items of every query row; ``items`` are already in tie order.

    The score is ``weight`` times the similarity plus the item's own part. One
    partition and one sort serve the whole block.
    """
    ids, votes, own = (items[c].to_numpy() for c in ("id", "vote_count", "own"))
    total = scores if weight == 1.0 and not own.any() else weight * scores + own
    row, item = _same(queries["source_id"].to_numpy(), ids)
    total = np.array(total) if total is scores and len(row) else total
    total[row, item] = -np.inf
    row, item = np.divmod(np.flatnonzero(total >= np.maximum(_floors(total, k), _LEAST)), max(1, len(ids)))
    whole, similar = total[row, item], np.round(scores[row, item], DIGITS)
    key = np.round(whole, DIGITS)
    order = np.lexsort((item, -similar, -key, row))
    order = order[np.arange(len(row)) - np.searchsorted(row, row) < k]
    row, item = row[order], item[order]
    values = [
        queries["query_id"].to_numpy()[row], ids[item], scores[row, item], whole[order], key[order], similar[order], votes[item],
    ]
    return [pd.DataFrame(dict(zip(_COLUMNS, values)))]


def _same(sources: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The (source, item) places of equal ids, which may come more than once; a missing id equals none."""
    wanted = np.argsort(sources, kind="stable")
    ordered = sources[wanted]
    first = np.searchsorted(ordered, ids)
    n = np.where(ids == ids, np.searchsorted(ordered, ids, "right") - first, 0)
    item = np.repeat(np.arange(len(ids)), n)
    return wanted[np.repeat(first - np.cumsum(n) + n, n) + np.arange(len(item))], item


def _floors(total: np.ndarray, k: int) -> np.ndarray | float:
    """A bound per row that no score falls below whose rounded value reaches the rounded k-th best one.

    The k-th best of the best scores of runs is reached by k items at least, so it is a bound, found without
    ordering every score of the row.
    """
    n = total.shape[1]
    if n <= k:
        return -np.inf
    best = total
    if n >= 2 * k * RUN:
        width = n // RUN
        runs = total[:, : width * RUN].reshape(len(total), RUN, width).max(axis=1)
        best = np.hstack([runs, total[:, width * RUN :]])
        if np.isnan(best).any():
            best = total
    at = best.shape[1] - k
    return np.partition(best, at, axis=1)[:, at][:, None] - _ROUNDING


def _in_tie_order(items: pd.DataFrame) -> pd.DataFrame:
    return items.sort_values(["vote_count", "id"], ascending=[False, True], kind="stable")


def _joined(parts: list[pd.DataFrame]) -> pd.DataFrame:
    if parts:
        return pd.concat(parts, ignore_index=True)
    return pd.DataFrame({c: [] for c in _COLUMNS})


def _scaled(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Values over sizes; where the size is zero the values stay zero."""
    return np.divide(values, sizes, out=np.zeros_like(values), where=sizes > 0)


def scaled_rows(table: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; a row of zeros stays."""
    return _scaled(table, np.linalg.norm(table, axis=1, keepdims=True))


def _unit_rows(vectors: pd.Series) -> np.ndarray:
    return scaled_rows(np.stack(vectors.to_numpy()).astype(float))


def _dense_kernel(k: int, weight: float, cells: int = 1 << 22):
    def kernel(queries: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        items = _in_tie_order(items)
        table = np.ascontiguousarray(_unit_rows(items["vector"]).T)
        chunk = max(1, cells // len(items))
        parts: list[pd.DataFrame] = []
        for start in range(0, len(queries), chunk):
            block = queries.iloc[start : start + chunk]
            scores = _unit_rows(block["vector"]) @ table
            parts += _best_of_block(scores, block, items, k, weight)
        return _joined(parts)

    return kernel


def _sparse_rows(block: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All entries of a block as (term, row, weight), the weights of a row scaled to length one."""
    lengths = block["indices"].map(len).to_numpy()
    terms = np.concatenate(block["indices"].to_numpy())
    weights = np.concatenate(block["values"].to_numpy()).astype(float)
    row = np.repeat(np.arange(len(block)), lengths)
    sizes = np.sqrt(np.bincount(row, weights * weights, minlength=len(block)))
    return terms.astype(np.int64), row, _scaled(weights, sizes[row])


def _sparse_kernel(k: int, weight: float, cells: int = 4_000_000):
    """Cosine of sparse vectors: only terms that some query holds are touched."""

    def kernel(queries: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        items = _in_tie_order(items)
        terms, item_row, weights = _sparse_rows(items)
        parts: list[pd.DataFrame] = []
        for start in range(0, len(queries), 128):
            block = queries.iloc[start : start + 128]
            q_terms, q_row, q_weights = _sparse_rows(block)
            known = np.unique(q_terms)
            table = np.zeros((len(known), len(block)))
            table[np.searchsorted(known, q_terms), q_row] = q_weights
            place = np.searchsorted(known, terms)
            shared = place < len(known)
            shared[shared] = known[place[shared]] == terms[shared]
            place, rows, values = place[shared], item_row[shared], weights[shared]
            scores = np.zeros((len(items), len(block)))
            step = max(1, cells // len(block))
            for a in range(0, len(place), step):
                part = rows[a : a + step]
                products = table[place[a : a + step]] * values[a : a + step, None]
                starts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
                scores[part[starts]] += np.add.reduceat(products, starts, axis=0)
            parts += _best_of_block(scores.T, block, items, k, weight)
        return _joined(parts)

    return kernel


def _found(queries, items, columns, kernel, k, within, weight, own, sizes) -> DataFrame:
    """The k best items of each query, with the columns of ``ORDER``."""
    votes = F.coalesce(F.col("vote_count").cast("double"), F.lit(0.0)) if "vote_count" in items.columns else F.lit(0.0)
    part = F.lit(0.0) if own is None else own
    left = queries.select(F.col("query_id").cast("bigint"), F.col("source_id").cast("bigint"), *columns, *within)
    right = items.select(
        F.col("id").cast("bigint"), votes.alias("vote_count"), part.alias("own"), *columns, *within
    )
    return best_matches(left, right, kernel(k, weight), _SCHEMA, ORDER, k, within=within, sizes=sizes, rank="retrieval_rank")


def _nearest(queries, items, columns, kernel, k, within, weight, own, sizes) -> DataFrame:
    found = _found(queries, items, columns, kernel, k, within, weight, own, sizes).drop("score_key", "similarity_key")
    return found if own is not None else found.drop("hybrid_score")


def best_dense(queries: DataFrame, items: DataFrame, k: int, within: Sequence[str], sizes: BlockSizes) -> DataFrame:
    """What ``nearest_dense`` finds, with the columns it is ordered by, so that several searches can be merged."""
    return _found(queries, items, ["vector"], _dense_kernel, k, within, 1.0, None, sizes)


def best_sparse(
    queries: DataFrame, items: DataFrame, k: int, within: Sequence[str], sizes: BlockSizes, weight: float = 1.0, own: Column | None = None
) -> DataFrame:
    """The same for ``nearest_sparse``."""
    return _found(queries, items, ["indices", "values"], _sparse_kernel, k, within, weight, own, sizes)


def large_sizes(n: int) -> BlockSizes:
    """Blocks for ``n`` items and about as many queries: as large as a task holds, while enough of them are left for all tasks."""
    return BlockSizes(query_rows=min(_LARGEST, max(DENSE_SIZES.query_rows, n // _QUERY_BLOCKS)), item_rows=_LARGEST)


def _visiting_kernel(k: int, cells: int = 1 << 22):
    """Cosine where a query meets the items of some places only: those whose bit is set in its ``bits``."""

    def kernel(queries: pd.DataFrame, items: pd.DataFrame) -> pd.DataFrame:
        items = _in_tie_order(items)
        table = np.ascontiguousarray(_unit_rows(items["vector"]).T)
        items = items.drop(columns="vector")
        place = items["place"].to_numpy()
        # queries of like visits leave out the same items
        queries = queries.sort_values("bits", kind="stable")
        bits = np.frombuffer(b"".join(queries["bits"]), np.uint8).reshape(len(queries), -1)
        chunk = max(1, cells // len(items))
        parts: list[pd.DataFrame] = []
        for start in range(0, len(queries), chunk):
            block = queries.iloc[start : start + chunk]
            asked = np.unpackbits(bits[start : start + chunk], axis=1).astype(bool)
            met = np.flatnonzero(asked.any(axis=0)[place])
            if not len(met):
                continue
            some, columns = (items, table) if len(met) == len(items) else (items.iloc[met], table[:, met])
            scores = _unit_rows(block["vector"]) @ columns
            visited = asked[:, place[met]]
            if not visited.all():
                scores[~visited] = -np.inf
            parts += _best_of_block(scores, block, some, k, 1.0)
        return _joined(parts)

    return kernel


def best_visited(queries: DataFrame, items: DataFrame, k: int, within: Sequence[str], sizes: BlockSizes) -> DataFrame:
    """``best_dense`` where a query meets only items whose ``place`` is set in its ``bits``."""
    votes = F.coalesce(F.col("vote_count").cast("double"), F.lit(0.0)) if "vote_count" in items.columns else F.lit(0.0)
    left = queries.select(F.col("query_id").cast("bigint"), F.col("source_id").cast("bigint"), "vector", "bits", *within)
    right = items.select(F.col("id").cast("bigint"), votes.alias("vote_count"), F.lit(0.0).alias("own"), "vector", "place", *within)
    return best_matches(left, right, _visiting_kernel(k), _SCHEMA, ORDER, k, within=within, sizes=sizes, rank="retrieval_rank")


def nearest_dense(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    within: Sequence[str] = (),
    weight: float = 1.0,
    own: Column | None = None,
    sizes: BlockSizes = DENSE_SIZES,
) -> DataFrame:
    """Exact top k by cosine of dense vectors.

    ``queries``: query_id, source_id (left out of its own result), vector.
    ``items``: id, vector, vote_count (tie-break; optional).
    ``within``: columns that must be equal, such as the cluster.
    ``own``: a score of the item itself; results then rank by weight * cosine + own
    over all items, not over a pool, and carry it as ``hybrid_score``.
    """
    return _nearest(queries, items, ["vector"], _dense_kernel, k, within, weight, own, sizes)


def sparse_columns(df: DataFrame, vector: str) -> DataFrame:
    """The indices and values of an ML sparse vector column."""
    plain = F.unwrap_udt(vector)
    return df.withColumns({"indices": plain["indices"], "values": plain["values"]})


def nearest_sparse(
    queries: DataFrame,
    items: DataFrame,
    k: int,
    within: Sequence[str] = (),
    weight: float = 1.0,
    own: Column | None = None,
    sizes: BlockSizes = BlockSizes(),
) -> DataFrame:
    """Exact top k by cosine of sparse vectors (``indices``, ``values``); see ``nearest_dense``."""
    return _nearest(queries, items, ["indices", "values"], _sparse_kernel, k, within, weight, own, sizes)
