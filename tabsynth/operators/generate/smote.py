"""SMOTE oversampling (G2, G2b) and label encoding.

* Missing target -> ``__missing_target__``; features imputed (exact median / mode) and
  text label-encoded (sorted distinct values -> 0..m-1, from the running-count kernel).
* Every class below the largest gets ``max - count`` new rows: base row and one of its
  k nearest same-class neighbours chosen by seeded hashes, new = x + u * (nn - x); encoded
  text is rounded (half to even), clipped and decoded.  Originals are kept, then the table
  is resized to n (R5).
* Exact kNN without emitting all pairs of a class: distinct vectors are ranked inside their
  class along a seeded 1-D projection and cut into blocks of that order.  Pairs of blocks are
  compared by matrix products in their own tasks: first a block with itself and its neighbours,
  which bounds the k-th distance of every vector, then with every further block whose
  projections come within that bound (the projection is 1-Lipschitz).  Distances that may count
  are summed exactly; a vector's copies are searched once.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ...functions import typeclass as tc
from ...functions.columns import clip_round, hash_u32, uniform
from ...plans import kernels as K
from ...session import written
from ..clean import median_values, mode_values
from ..sample import resample_to

MISSING_TARGET = "__missing_target__"
MAX_K = 5
SEED = 42
EPS = float(np.finfo(float).eps)
STRIP = 512  # vectors compared with a whole block at a time


def label_encoding(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, code) -- sorted distinct values of each text column numbered
    0..m-1 (``dense_rank`` computed with the range-split kernel, no single-task window)."""
    vc = K.value_counts_long(df, cols, "string")
    pos = K.positions(vc.select("column", "value"), ["column"], ["value"], name="code")
    return pos.select("column", "value", "code")


def label_encode(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """Add ``name`` (default ``<col>_code``) with the label code of ``col`` (NULL stays NULL)."""
    name = name or f"{col}_code"
    enc = label_encoding(df, [col]).where(F.col("column") == col).select(
        F.col("value").alias("_v"), F.col("code").alias(name))
    return df.join(enc, df[f"`{col}`"].cast("string") == enc["_v"], "left").drop("_v")


def _features(df: DataFrame, target: str, empty: str = "missing") -> tuple[DataFrame, list[str], dict]:
    """Impute and encode the feature columns; returns (frame with _y and f_i doubles,
    feature names, decode info).  A text column without values is filled with ``empty``."""
    feats = [c for c in df.columns if c != target]
    if not feats:
        raise ValueError("there is no column beside the target")
    types = {f.name: f.dataType for f in df.schema.fields}
    num = [c for c in feats if tc.is_numeric(types[c])]
    other = [c for c in feats if c not in num]
    med = median_values(df, num) if num else {}
    modes = mode_values(df, other, "string") if other else {}
    y = F.coalesce(F.col(f"`{target}`").cast("string"), F.lit(MISSING_TARGET)).alias("_y")
    base = df.select(
        y,
        *[F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float(med[c]))).alias(f"_n{i}") for i, c in enumerate(num)],
        *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(modes.get(c, empty))).alias(f"_s{j}") for j, c in enumerate(other)],
    )
    info = {"num": num, "other": other, "types": types, "levels": {}}
    if other:
        enc = written(label_encoding(base.select(*[f"_s{j}" for j in range(len(other))]),
                                     [f"_s{j}" for j in range(len(other))]), "smote-levels")
        for j, c in enumerate(other):
            e = enc.where(F.col("column") == f"_s{j}").select(F.col("value").alias(f"_s{j}"), F.col("code").alias(f"_c{j}"))
            base = base.join(e, f"_s{j}", "left")
            info["levels"][c] = enc.where(F.col("column") == f"_s{j}").select(
                F.col("value").alias("_v"), F.col("code").alias("_code"))
        info["n_levels"] = {c: r["n"] for c, r in zip(other, [
            enc.where(F.col("column") == f"_s{j}").agg(F.count(F.lit(1)).alias("n")).first() for j in range(len(other))])}
    fcols = [f"_n{i}" for i in range(len(num))] + [f"_c{j}" for j in range(len(other))]
    base = base.select("_y", *[F.col(c).cast("double").alias(c) for c in fcols])
    return base, fcols, info


def knn_within_class(df: DataFrame, key: str, cls: str, feats: list[str], k: int, seed: int = SEED,
                     queries: DataFrame | None = None, block: int | None = None) -> DataFrame:
    """Exact k nearest neighbours (squared Euclidean, same class, not itself; equal distances by
    key): (``key``, nn_key, nn_rank 1..k, dist2).  ``queries`` (a frame of ``key``) limits the
    rows that need neighbours."""
    d = len(feats)
    block = block or min(8192, max(1024, 128 * d))  # the projection of wide rows rules out less
    # direction of the projection: feature spreads (so a dominant feature dominates the
    # projection as it dominates distances) with seeded signs; d numbers from one pass
    st = df.agg(*[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(feats)], *[F.max(F.abs(F.col(f))).alias(f"m{i}") for i, f in enumerate(feats)],
                F.count(F.lit(1)).alias("rows")).first()
    ranges = K.partitions(df.sparkSession, st["rows"])  # tasks follow the rows, so a task's share does not grow with them
    rng = np.random.default_rng(seed)
    w = np.array([float(st[f"s{i}"] or 0.0) for i in range(d)]) * rng.choice([-1.0, 1.0], size=d) * rng.uniform(0.5, 1.0, size=d)
    if not np.any(w):
        w = np.ones(d)
    w = w / np.linalg.norm(w)
    slack = 4.0 * (d + 4) * EPS * sum(abs(x) * float(st[f"m{i}"] or 0.0) for i, x in enumerate(w))  # of two rounded projections
    proj = sum((F.col(f) * float(w[i]) for i, f in enumerate(feats)), F.lit(0.0))
    pts = df.select(F.col(key).alias("_k"), F.col(cls).alias("_cls"), F.array(*[F.col(f).cast("double") for f in feats]).alias("_x"), proj.alias("_proj"))
    # copies: only the k + 1 smallest keys of a vector can be neighbours, and it is searched once
    pts = K.positions(pts, ["_cls", "_x"], [F.col("_k")], name="_copy", n_ranges=ranges)
    pts = K.prefix_sums(pts, ["_cls"], [F.col("_proj"), F.col("_x"), F.col("_copy")], [(F.col("_copy") == 0).cast("long")], prefix="_v", n_ranges=ranges)
    pts = written(pts.withColumn("_v", F.col("_v0") - 1).drop("_v0"), "smote-vectors")
    near = pts.where(F.col("_copy") <= k).groupBy("_cls", "_v").agg(F.sort_array(F.collect_list("_k")).alias("_keys"))
    vecs = pts.where(F.col("_copy") == 0).select("_cls", "_v", F.floor(F.col("_v") / block).cast("long").alias("_b"), "_x", "_proj", "_k")
    asked = pts if queries is None else pts.join(queries.select(F.col(key).alias("_k")).distinct(), "_k")
    asked = written(asked.select("_k", "_cls", "_v"), "smote-asked")
    search = vecs if queries is None else vecs.join(asked.select("_cls", "_v").distinct(), ["_cls", "_v"])
    search = search.select("_cls", "_v", "_b", "_x", "_proj")
    spans = vecs.groupBy("_cls", "_b").agg(F.min("_proj").alias("_lo"), F.max("_proj").alias("_hi"), F.count(F.lit(1)).alias("_n")).checkpoint()  # one row a block
    near_rows = 3 * (k + 1) * (spans.agg(F.sum("_n")).first()[0] or 0)  # that the blocks around those of the vectors give
    spans = spans.drop("_n")

    def nearest(pairs: DataFrame) -> DataFrame:
        """The k + 1 nearest vectors of every searched vector in the candidate block of its pair."""
        left = pairs.select(*[F.col(c).alias(c) for c in pairs.columns])  # apart from the pairs that the candidates come by
        right = pairs.select("_cls", "_b", "_c").distinct().join(vecs.select("_cls", F.col("_b").alias("_c"), "_v", "_x", "_k"), ["_cls", "_c"])
        right = right.select(*[F.col(c).alias(c) for c in right.columns])
        at = ["_cls", "_b", "_c"]
        schema = T.StructType([T.StructField("_cls", vecs.schema["_cls"].dataType), *T._parse_datatype_string("_v long, _cv long, _d double").fields,
                               T.StructField("_ck", vecs.schema["_k"].dataType)])
        return left.groupBy(*at).cogroup(right.groupBy(*at)).applyInArrow(_nearest_in_block(k + 1, d), schema)

    around = F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1))
    first = written(nearest(search.withColumn("_c", around).withColumn("_most", F.lit(float("inf")))), "smote-near")
    kth = _closest(first, near_rows, k + 1).groupBy("_cls", "_v").agg(F.max("_d").alias("_most"), F.count(F.lit(1)).alias("_got"))
    kth = kth.select("_cls", "_v", F.when(F.col("_got") > k, F.col("_most")).otherwise(F.lit(float("inf"))).alias("_most"))
    # further blocks whose projections are near enough to hold a nearer vector; a projection is 1-Lipschitz
    gap = F.greatest(F.col("_lo") - F.col("_proj"), F.col("_proj") - F.col("_hi")) - slack
    more = search.join(kth, ["_cls", "_v"], "left").join(F.broadcast(spans.withColumnRenamed("_b", "_c")), "_cls")
    more = more.where((F.abs(F.col("_c") - F.col("_b")) > 1) & ((gap <= 0) | (gap * gap * (1 - 8 * EPS) <= F.coalesce("_most", F.lit(float("inf"))))))
    more = more.select("_cls", "_v", "_b", "_x", "_proj", "_c", F.coalesce("_most", F.lit(float("inf"))).alias("_most"))
    found = _closest(first.unionByName(nearest(more)), near_rows, k + 1)
    # of every vector the k + 1 nearest rows; a row's own key goes, the first k others stay
    found, near = (K.dealt(x, near_rows, ["_cls", "_cv"]) for x in (found, near.withColumnRenamed("_v", "_cv")))
    rows = found.join(near, ["_cls", "_cv"]).select("_cls", "_v", F.explode(F.transform("_keys", lambda x: F.struct(F.col("_d").alias("d"), x.alias("k")))).alias("_n"))
    lists = K.dealt(rows, near_rows, ["_cls", "_v"]).groupBy("_cls", "_v").agg(F.slice(F.sort_array(F.collect_list("_n")), 1, k + 1).alias("_n"))  # (k + 1) x (k + 1) at most
    out = asked.join(lists, ["_cls", "_v"])
    out = out.select("_k", F.posexplode(F.slice(F.filter("_n", lambda n: n["k"] != F.col("_k")), 1, k)).alias("_at", "_n"))
    return out.select(F.col("_k").alias(key), F.col("_n.k").alias("nn_key"), (F.col("_at") + 1).alias("nn_rank"), F.col("_n.d").alias("dist2"))


def _closest(found: DataFrame, rows: int, n: int) -> DataFrame:
    """Of (_cls, _v, _cv, _d, _ck) the ``n`` smallest distances of each vector, equal ones by the
    candidates' smallest keys ``_ck``; a few times ``n`` rows a vector come in, about ``rows`` in all."""
    at = F.row_number().over(Window.partitionBy("_cls", "_v").orderBy("_d", "_ck"))
    found = K.dealt(found, rows, ["_cls", "_v"]).withColumn("_at", at)
    return found.where(F.col("_at") <= n).select("_cls", "_v", "_cv", "_d")


def _nearest_in_block(n: int, d: int):
    """Task of a pair of blocks: a matrix product bounds the distances, and only those that may be
    among the ``n`` smallest are summed exactly, feature by feature."""
    def matrix(table):
        return table.column("_x").combine_chunks().flatten().to_numpy().reshape(-1, d)

    def run(left, right):
        kinds = [left.schema.field("_cls").type, pa.int64(), pa.int64(), pa.float64()]
        parts = []
        if len(left) and len(right):
            right = right.sort_by("_k")  # among equal distances the smallest keys come first
            a, b = matrix(left), matrix(right)
            mid = a.mean(axis=0)
            a0, b0 = a - mid, b - mid
            na, nb = (a0 * a0).sum(axis=1), (b0 * b0).sum(axis=1)
            most, cv, v = (t.column(c).to_numpy() for t, c in ((left, "_most"), (right, "_v"), (left, "_v")))
            for i in range(0, len(a), STRIP):
                s = slice(i, i + STRIP)
                rough = na[s, None] + nb[None, :] - 2.0 * (a0[s] @ b0.T)
                off = 8.0 * (d + 8) * EPS * (na[s] + nb.max() + 1e-300)  # of a rough distance, either way
                top = np.full(len(rough), np.inf)
                if len(b) > n:
                    top = np.partition(rough, n - 1, axis=1)[:, n - 1] + 2 * off
                q, c = np.nonzero(rough <= np.minimum(top, most[s] + off + 8 * EPS * np.abs(most[s]))[:, None])
                exact = np.zeros(len(q))
                for f in range(d):
                    exact += (a[s][q, f] - b[c, f]) ** 2
                order = np.lexsort((c, exact, q))  # c is the place by key
                q, c, exact = q[order], c[order], exact[order]
                keep = (np.arange(len(q)) - np.searchsorted(q, q) < n) & (exact <= most[s][q])
                parts.append((v[s][q[keep]], cv[c[keep]], exact[keep], c[keep]))
        vs, cvs, ds, places = (np.concatenate([p[j] for p in parts]) if parts else np.zeros(0, t) for j, t in enumerate((np.int64, np.int64, float, np.int64)))
        keys = right.column("_k").take(pa.array(places)).combine_chunks()
        cls = pa.array([left.column("_cls")[0].as_py()] * len(vs) if len(vs) else [], kinds[0])
        return pa.Table.from_arrays([cls, *[pa.array(x, t) for x, t in zip((vs, cvs, ds), kinds[1:])], keys], names=["_cls", "_v", "_cv", "_d", "_ck"])
    return run


def smote_balance(df: DataFrame, target: str, seed: int = SEED,
                  k: int | None = None, empty: str = "missing") -> tuple[DataFrame, list[str], dict]:
    """Originals plus generated rows so every class has as many rows as the largest
    (encoded features, ``_y`` class label, ``_generated`` flag), the feature column names
    and the decoding information."""
    if not target or target not in df.columns:
        raise ValueError(f"there is no target column {target!r}")
    base, fcols, info = _features(df, target, empty)
    # every step is written, so that the next one's plan begins with a scan: the text of nested
    # cached plans would double with each step that reads one twice, all of it on the driver
    base = written(base, "smote-base")
    counts = base.groupBy("_y").agg(F.count(F.lit(1)).alias("_cnt"))
    st = counts.agg(F.count(F.lit(1)).alias("classes"), F.min("_cnt").alias("mn"), F.max("_cnt").alias("mx"), F.sum("_cnt").alias("rows")).first()
    if st["classes"] < 2:
        raise ValueError("the target has a single class")
    if st["mn"] < 2:
        raise ValueError("a class has a single row, so it has no neighbours")
    kk = k if k is not None else max(1, min(MAX_K, st["mn"] - 1))
    mx = st["mx"]
    # stable row key and position inside the class
    keyed = base.withColumn("_h", hash_u32(seed, "smote-key", *fcols, "_y"))
    keyed = K.positions(keyed, ["_y"], [F.col("_h"), *[F.col(c) for c in fcols]], name="_pos", n_ranges=K.partitions(df.sparkSession, st["rows"]))
    keyed = written(keyed.withColumn("_key", F.concat_ws("#", F.col("_pos").cast("string"), F.col("_y"))), "smote-keyed")
    # generated draws: class c needs mx - cnt rows
    need = written(counts.where(F.col("_cnt") < mx).select("_y", "_cnt", (F.lit(mx) - F.col("_cnt")).alias("_m")), "smote-need")
    if need.isEmpty():
        return keyed.select("_y", *fcols, F.lit(False).alias("_generated")), fcols, info
    drawn = mx * st["classes"] - st["rows"]
    draws = K.numbered(need, "_m", "_s", ["_y"])
    draws = draws.select(
        "_y", "_s",
        F.floor(uniform(seed, "smote-base", F.col("_y"), F.col("_s")) * F.col("_cnt")).cast("long").alias("_pos"),
        (F.floor(uniform(seed, "smote-nn", F.col("_y"), F.col("_s")) * F.least(F.lit(kk), F.col("_cnt") - 1)) + 1).cast("int").alias("nn_rank"),
        uniform(seed, "smote-gap", F.col("_y"), F.col("_s")).alias("_gap"),
    )
    bases = written(K.joined(draws, keyed.select("_y", "_pos", "_key", *fcols), ["_y", "_pos"], max(st["rows"], drawn)), "smote-bases")
    minority = keyed.join(need.select("_y"), "_y")
    nn = knn_within_class(minority, "_key", "_y", fcols, kk, seed, queries=bases.select("_key"))
    nbr = keyed.select(F.col("_key").alias("nn_key"), *[F.col(c).alias(f"nb_{c}") for c in fcols])
    syn = K.joined(bases, nn.select(F.col("_key"), "nn_key", "nn_rank"), ["_key", "nn_rank"], max(kk * st["rows"], drawn)).join(nbr, "nn_key")
    syn = syn.select("_y", *[(F.col(c) + F.col("_gap") * (F.col(f"nb_{c}") - F.col(c))).alias(c) for c in fcols],
                     F.lit(True).alias("_generated"))
    orig = keyed.select("_y", *fcols, F.lit(False).alias("_generated"))
    return orig.unionByName(syn), fcols, info


def decode(balanced: DataFrame, df: DataFrame, target: str, fcols: list[str], info: dict) -> DataFrame:
    """Back to the input schema: numbers cast back, codes rounded/clipped and decoded,
    the target restored (``__missing_target__`` becomes missing for non-text targets)."""
    types = info["types"]
    out = balanced
    sel = {}
    for i, c in enumerate(info["num"]):
        t = types[c]
        v = F.col(f"_n{i}")
        if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
            v = F.rint(v)
        sel[c] = v.cast(t)
    for j, c in enumerate(info["other"]):
        m = info["n_levels"][c]
        out = out.withColumn(f"_c{j}", clip_round(F.col(f"_c{j}"), max(0, m - 1)))
        lv = info["levels"][c].select(F.col("_v").alias(f"_d{j}"), F.col("_code").alias(f"_c{j}"))
        out = out.join(lv, f"_c{j}", "left")
        t = types[c]
        sel[c] = F.col(f"_d{j}") if tc.is_text(t) else (F.lower(F.col(f"_d{j}")) == "true" if isinstance(t, T.BooleanType) else F.col(f"_d{j}").cast(t))
    tt = types[target]
    ycol = F.when(F.col("_y") == MISSING_TARGET, F.lit(None if not tc.is_text(tt) else MISSING_TARGET)).otherwise(F.col("_y"))
    sel[target] = ycol.cast(tt)
    return out.select(*[sel[c].alias(c) for c in df.columns])


EMPTY_VARIANT = "__missing__"  # fixed value: what the variant puts into a column without values


def generate_smote(df: DataFrame, target: str, n: int, seed: int = SEED, k: int | None = None, variant: bool = False) -> DataFrame:
    """Balance classes with SMOTE, then resize to n rows (R5).  G2b (``variant``): a text
    column without values becomes ``__missing__``, and the balanced rows are only ever drawn
    without replacement, so at most all of them come back."""
    if n <= 0:
        raise ValueError(f"cannot draw {n} rows")
    bal, fcols, info = smote_balance(df, target, seed, k, EMPTY_VARIANT if variant else "missing")
    decoded = K._cut(decode(bal, df, target, fcols, info))
    return resample_to(decoded, min(n, decoded.count()) if variant else n, None, seed)


__all__ = ["label_encoding", "label_encode", "knn_within_class", "smote_balance", "generate_smote", "decode",
           "MISSING_TARGET", "math", "Column"]
