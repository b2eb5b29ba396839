"""Ranked text retrieval over chunks: term statistics, lexicon, BM25, cosine, fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulsegrid.functions.stems import may_have_stem, stems_of
from pulsegrid.operators.rollup import r

CHUNK, STRIDE, K1, B, RRF_K, LEAST_CHUNKS, RATE = 1200, 1000, 1.2, 0.75, 60, 3, 3.0


def chunks(docs: DataFrame, id_col: str = "doc_id", size: int = CHUNK, stride: int = STRIDE) -> DataFrame:
    """Overlapping slices of each text; the last one reaches its end."""
    n = F.greatest(F.lit(1), F.ceil((F.length("text") - (size - stride)) / stride))
    spread = docs.where("text is not null").select(id_col, "text", F.explode(F.sequence(F.lit(0), n.cast("int") - 1)).alias("chunk_no"))
    return spread.select(id_col, "chunk_no", F.substring(F.col("text"), F.col("chunk_no") * stride + 1, F.lit(size)).alias("body"))


def terms(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda t: t != "")


def document_frequency(chunked: DataFrame) -> DataFrame:
    return chunked.select(F.explode(F.array_distinct(terms(F.col("body")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def stem_frequency(chunked: DataFrame) -> DataFrame:
    """``stem`` and the number of chunks that hold a word of it.

    A chunk is told by its columns other than its body; rows that share them are one chunk.
    Words stay in their chunk's row: only what a partition has counted of a stem is dealt
    out, and of chunks in several rows each stem."""
    keys = [c for c in chunked.columns if c != "body"]
    held = chunked.select(*keys, F.array_distinct(stems_of(F.array_distinct(terms(F.col("body"))))).alias("stems"))
    times = held.withColumn("times", F.count("*").over(Window.partitionBy(*keys)))
    alone = times.where("times = 1").select(F.explode("stems").alias("stem"))
    shared = times.where("times > 1").select(*keys, F.explode("stems").alias("stem")).distinct().select("stem")
    return alone.unionByName(shared).groupBy("stem").agg(F.count("*").alias("df"))


def lexicon(own: DataFrame, control: DataFrame, least: int = LEAST_CHUNKS, rate: float = RATE) -> DataFrame:
    """Stems of enough chunks whose rate is several times that of the control chunks."""
    a, b = stem_frequency(own), stem_frequency(control).withColumnRenamed("df", "control_df")
    sizes = own.agg(F.count("*").alias("n")).crossJoin(control.agg(F.count("*").alias("m")))
    joined = a.where(F.col("df") >= least).join(b, "stem", "left").crossJoin(F.broadcast(sizes))
    held = F.coalesce("control_df", F.lit(0))
    return joined.where(F.col("df") * F.col("m") >= rate * held * F.col("n")).select("stem", "df", held.alias("control_df"))


def bm25(chunked: DataFrame, keys: list[str], stems: list[str]) -> DataFrame:
    """BM25 of every chunk with a word of one of the query's ``stems``.

    A chunk's words are filtered in its row, by their first letters before their stems are
    worked out; only what is left becomes rows."""
    def wanted(t: Column) -> Column:
        out = F.lit(False)
        for s in stems:
            out = out | may_have_stem(t, s)
        return out

    counted = chunked.select(*keys, terms(F.col("body")).alias("t"))
    totals = chunked.agg(F.count("*").alias("n"), F.avg(F.size(terms(F.col("body")))).alias("avgdl"))
    found = counted.select(*keys, F.size("t").alias("dl"), stems_of(F.filter("t", wanted)).alias("t"))
    hits = found.select(*keys, "dl", F.explode("t").alias("stem")).where(F.col("stem").isin(stems)).groupBy(*keys, "dl", "stem").agg(F.count("*").alias("tf"))
    df = hits.groupBy("stem").agg(F.count_if(F.col("tf") > 0).alias("df"))  # reads tf, so that it shares the hits' exchange
    joined = hits.join(F.broadcast(df), "stem").crossJoin(F.broadcast(totals))  # as many rows as the query has stems, and one
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return joined.groupBy(*keys).agg(r(F.sum(part)).alias("score"))


def ranked(scored: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The best ``size`` rows with their rank; ties by key."""
    top = scored.orderBy(F.col("score").desc(), *keys).limit(size)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), *keys)))


def cosine(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """Cosine of every vector with one query vector (vec_id, embedding)."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    one = query.select(F.col("embedding").alias("q")).limit(1)
    joined = vectors.crossJoin(F.broadcast(one))  # one row
    e, q = F.col("embedding"), F.col("q")
    return joined.select("vec_id", r(dot(e, q) / F.sqrt(dot(e, e) * dot(q, q)), 5).alias("score"))


def fused(a: DataFrame, b: DataFrame, key: str, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists."""
    both = a.select(key, F.col("rank").alias("rank_a")).join(b.select(key, F.col("rank").alias("rank_b")), key, "full_outer")
    part = lambda c: F.when(F.col(c).isNotNull(), 1 / (k + F.col(c))).otherwise(0.0)
    return both.withColumn("score", F.round(part("rank_a") + part("rank_b"), 8))
