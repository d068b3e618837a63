"""Comparisons of two sets of vectors, block by block: a task holds two blocks at a time and multiplies them as matrices.

The product only proposes pairs, with a margin for its rounding; their cosines are then summed number by number, as
``functions.vector`` has it, so that results are the same to the last bit. Work is quadratic in the sets by nature; memory isn't:
a block holds at most 2 million numbers, a product at most 4 million, and results leave as they are found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..functions.vector import TINY

#: Numbers in a block, its vectors at most, cosines in a product, pairs of vectors that are worth a task.
NUMBERS, ROWS, TILE, WORK = 1 << 21, 1 << 15, 1 << 22, 1 << 24
MARGIN = 1e-9


class Block:
    """Ids, vectors (padded), their lengths and norms, and unit vectors; those that can't be compared are zero in ``unit``."""

    def __init__(self, ids: pa.Array, vectors: pa.Array):
        self.ids, n = ids, len(ids)
        self.size = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = vectors.flatten()
        real, width = np.maximum(self.size, 0), int(max(self.size.max(initial=0), 0))
        held = np.arange(width) < real[:, None]
        self.x = np.zeros((n, width))
        self.x[held] = flat.to_numpy(zero_copy_only=False)
        gap = np.zeros((n, width), bool)
        if flat.null_count:
            gap[held] = flat.is_null().to_numpy(zero_copy_only=False)
        with np.errstate(all="ignore"):
            self.norm = np.sqrt(np.cumsum(self.x * self.x, axis=1)[:, -1]) if width else np.zeros(n)
            self.fine = (self.size > 0) & ~(self.norm < TINY) & ~gap.any(axis=1)
            self.unit = np.where(self.fine[:, None], self.x / self.norm[:, None], 0.0)

    def pad(self, width: int) -> None:
        if (more := width - self.x.shape[1]) > 0:
            self.x, self.unit = (np.pad(m, ((0, 0), (0, more))) for m in (self.x, self.unit))


def cosines(a: Block, b: Block, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """As ``vector.cosine`` of the pairs (r, c): sums from the first number to the last, in doubles."""
    out = np.zeros(len(r))
    if not a.x.shape[1]:
        return out
    with np.errstate(all="ignore"):
        for k in range(0, len(r), 1 << 14):
            i, j = r[k : k + (1 << 14)], c[k : k + (1 << 14)]
            p = a.x[i] * b.x[j]
            np.cumsum(p, axis=1, out=p)
            fine = a.fine[i] & b.fine[j] & (a.size[i] == b.size[j])
            out[k : k + (1 << 14)] = np.where(fine, p[:, -1] / (a.norm[i] * b.norm[j]), 0.0)
    return out


def tiles(a: Block, b: Block) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, approximate cosines of some rows of ``a`` with all of ``b``). NaN is -3."""
    width = max(a.x.shape[1], b.x.shape[1])
    a.pad(width), b.pad(width)
    mixed = len(np.unique(np.concatenate([a.size[a.fine], b.size[b.fine]]))) > 1
    odd = not (np.isfinite(a.unit).all() and np.isfinite(b.unit).all())
    step = max(1, TILE // max(1, len(b.ids)))
    for k in range(0, len(a.ids), step):
        with np.errstate(all="ignore"):
            s = a.unit[k : k + step] @ b.unit.T
        if odd:
            s[np.isnan(s)] = -3.0
        if mixed:
            s[a.size[k : k + step, None] != b.size] = 0.0
        yield k, s


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As ``F.round``, half up on the decimals that a number is written with; as whole numbers of the last digit."""
    y = np.abs(x) * 10.0**digits
    out = np.floor(y + 0.5)
    for k in np.flatnonzero(np.abs(y - np.floor(y) - 0.5) < 1e-3):
        out[k] = float(Decimal(repr(float(abs(x[k])))).scaleb(digits).quantize(Decimal(1), ROUND_HALF_UP))
    return np.copysign(out, x)


def blocked(left: DataFrame, right: DataFrame, run: Callable[[Block, Block, bool], Iterator[tuple]], schema: T_.StructType, by: str | None = None, half: bool = False) -> DataFrame:
    """The rows of ``run`` over pairs of blocks of ``left`` and ``right`` (id, embedding), of equal ``by`` if named.

    ``half``: ``right`` is ``left``, each pair of blocks comes once. ``run`` is told whether it has one block with itself.
    """
    width = F.coalesce(F.max(F.size("embedding")), F.lit(1)).alias("w")
    per = lambda w: F.greatest(F.lit(1), F.least(F.lit(ROWS), F.floor(F.lit(NUMBERS) / F.greatest(w, F.lit(1)))))
    names = ["id", "embedding"] if by is None else ["id", "embedding", by]
    left, right = left.select(*names), right.select(*names)
    block = lambda n: F.pmod(F.xxhash64("id"), n)
    if by is None:
        count = lambda df: df.agg(F.count("*").alias("n"), width).first()
        a = count(left)
        b = a if half else count(right)
        most = max(1, min(ROWS, NUMBERS // max(a["w"], b["w"], 1)))
        tasks = min(64, -(-a["n"] * b["n"] // WORK))
        if half:
            n = m = max(1, -(-a["n"] // most), int(np.ceil(np.sqrt(tasks))))
            both = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda x: F.struct((F.least(F.col("_b"), x) * n + F.greatest(F.col("_b"), x)).cast("int").alias("_key"), (F.col("_b") > x).alias("_side")))
            rows = left.withColumn("_b", block(F.lit(n))).select("id", "embedding", F.inline(both))
        else:
            n, m = max(1, -(-a["n"] // most)), max(1, -(-b["n"] // most))
            m = max(m, -(-tasks // n))
            x = left.withColumn("_b", block(F.lit(n))).select("id", "embedding", F.explode(F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda j: (F.col("_b") * m + j).cast("int"))).alias("_key"), F.lit(False).alias("_side"))
            y = right.withColumn("_b", block(F.lit(m))).select("id", "embedding", F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i * m + F.col("_b")).cast("int"))).alias("_key"), F.lit(True).alias("_side"))
            rows = x.unionByName(y)
        rows = rows.repartitionById(n * m, "_key")
    else:
        count = lambda df, n, w: df.groupBy(by).agg(F.count("*").alias(n), width.alias(w))
        size = count(left, "_na", "_wa").join(count(right, "_nb", "_wb"), by)
        most, pairs = per(F.greatest("_wa", "_wb")), F.col("_na").cast("double") * F.col("_nb")
        n = F.ceil(F.col("_na") / most)
        m = F.greatest(F.ceil(F.col("_nb") / most), F.ceil(F.least(F.lit(64), F.ceil(pairs / WORK)) / n))
        size = size.select(by, n.alias("_n"), m.alias("_m"), pairs.alias("_pairs"))
        tasks = min(4096, int((size.agg(F.sum(F.greatest(F.col("_pairs") / WORK, F.lit(0.01)))).first()[0] or 0) * 2) + 1)
        key = lambda i, j: F.to_json(F.struct(F.col(by), i.alias("i"), j.alias("j")))
        x = left.join(size, by).select("id", "embedding", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1), lambda j: key(block(F.col("_n")), j))).alias("_key"), F.lit(False).alias("_side"))
        y = right.join(size, by).select("id", "embedding", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1), lambda i: key(i, block(F.col("_m"))))).alias("_key"), F.lit(True).alias("_side"))
        rows = x.unionByName(y).repartition(tasks, "_key").sortWithinPartitions("_key")
    names, own = [f.name for f in schema.fields], n if half else 0

    def one(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(parts).combine_chunks()
        side = t["_side"]
        make = lambda part: Block(part["id"].combine_chunks(), part["embedding"].combine_chunks())
        key, a = t["_key"][0].as_py(), t.filter(pc.invert(side))
        same = half and key // own == key % own
        b = a if same else t.filter(side)
        if not len(a) or not len(b):
            return
        first = make(a)
        for columns in run(first, first if same else make(b), same):
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            key = batch.column("_key")
            cuts = [0, *(np.flatnonzero(pc.not_equal(key[1:], key[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist(), len(batch)]
            for lo, hi in zip(cuts, cuts[1:]):
                if parts and parts[-1].column("_key")[0] != key[lo]:
                    yield from one(parts)
                    parts = []
                parts.append(batch.slice(lo, hi - lo))
        if parts:
            yield from one(parts)

    return rows.mapInArrow(each, schema)


def _schema(left: DataFrame, right: DataFrame) -> T_.StructType:
    return T_.StructType([T_.StructField("left_id", left.schema["id"].dataType), T_.StructField("right_id", right.schema["id"].dataType), T_.StructField("cosine", T_.DoubleType())])


def close(left: DataFrame, right: DataFrame, within: float, by: str | None = None) -> DataFrame:
    """left_id, right_id, cosine of all pairs nearer than ``within``."""

    def run(a: Block, b: Block, _same: bool):
        for k, s in tiles(a, b):
            r, c = np.nonzero(s > 1 - within - MARGIN)
            for p in range(0, len(r), 1 << 18):
                i, j = r[p : p + (1 << 18)] + k, c[p : p + (1 << 18)]
                e = cosines(a, b, i, j)
                keep = np.maximum(1 - e, 0.0) < within
                yield a.ids.take(pa.array(i[keep])), b.ids.take(pa.array(j[keep])), e[keep]

    return blocked(left, right, run, _schema(left, right), by)


def best(left: DataFrame, right: DataFrame, k: int, digits: int, within: float | None = None, above: float | None = None, others: bool = False, by: str | None = None) -> DataFrame:
    """left_id, right_id, cosine: of each pair of blocks the ``k`` nearest to each on the left, ``digits`` of them counted, ties by
    id; the caller takes the best of these. With ``within`` by distance and nearer than that; else by cosine, more than
    ``above`` if given. ``others``: rows of equal id don't meet."""
    by_distance = within is not None
    least = 1 - within if by_distance else -np.inf if above is None else above
    slack = MARGIN + 2 * 10.0**-digits

    def run(a: Block, b: Block, _same: bool):
        left_ids, right_ids = (x.ids.to_numpy(zero_copy_only=False) for x in (a, b))
        for at, s in tiles(a, b):
            if others:
                s[left_ids[at : at + len(s), None] == right_ids] = -np.inf
            top = s.max(axis=1) if k == 1 else np.partition(s, max(0, s.shape[1] - k), axis=1)[:, max(0, s.shape[1] - k)]
            r, c = np.nonzero(s >= np.maximum(np.maximum(top, least) - slack, -4.0)[:, None])
            i = r + at
            e = cosines(a, b, i, c)
            d = np.maximum(1 - e, 0.0)
            # NaN is beyond all others, as Spark has it.
            keep = d < within if by_distance and np.isfinite(within) else e > above if above is not None else np.ones(len(e), bool)
            i, c, e, d = i[keep], c[keep], e[keep], d[keep]
            rank = np.nan_to_num(rounded(d, digits) if by_distance else -rounded(e, digits), nan=np.inf)
            order = np.lexsort((right_ids[c], rank, i))
            i, c, e = i[order], c[order], e[order]
            new = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.zeros(0, int)
            place = np.arange(len(i)) - np.repeat(new, np.diff(np.append(new, len(i))))
            i, c, e = i[place < k], c[place < k], e[place < k]
            yield a.ids.take(pa.array(i)), b.ids.take(pa.array(c)), e

    return blocked(left, right, run, _schema(left, right), by)


def unite(root: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """``root`` (the smallest place of each one's part) once the parts of r and c are one."""
    while True:
        a, b = root[r], root[c]
        if not (apart := a != b).any():
            return root
        r, c, a, b = r[apart], c[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (nearer := root[root]).tobytes() != root.tobytes():
            root = nearer


def links(items: DataFrame, within: float) -> DataFrame:
    """left_id, right_id: links that connect just what pairs nearer than ``within`` connect. Two blocks give fewer links than they have rows, however many copies there are."""
    schema = T_.StructType(_schema(items, items).fields[:2])

    def run(a: Block, b: Block, same: bool):
        n = len(a.ids)
        root = np.arange(n if same else n + len(b.ids))
        shift = 0 if same else n
        for k, s in tiles(a, b):
            apart = root[k : k + len(s), None] != root[shift : shift + s.shape[1]]
            r, c = np.nonzero((s > 1 - within - MARGIN) & apart)
            edge = s[r, c] <= 1 - within + MARGIN
            e = np.zeros(len(r), bool)
            e[edge] = ~(np.maximum(1 - cosines(a, b, r[edge] + k, c[edge]), 0.0) < within)
            root = unite(root, r[~e] + k, c[~e] + shift)
        ids = a.ids if same else pa.concat_arrays([a.ids, b.ids])
        moved = np.flatnonzero(root != np.arange(len(root)))
        yield ids.take(pa.array(moved)), ids.take(pa.array(root[moved]))

    return blocked(items, items, run, schema, half=True)
