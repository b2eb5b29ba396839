"""How the sources of each language differ: term shares of a source against those of every
other source and of the language as a whole.

Texts of a run lie end to end in one UTF-8 buffer.  A lookup table marks the bytes of
terms, whose boundaries are where marks change; slices are grouped by xxHash and held
against the first of their group byte by byte, so that equal hashes of different terms do
no harm.  Counts of a run are rows of a sparse matrix, groups by terms; Spark adds them up.

The terms of a language are then dealt to blocks of about ``BLOCK_ROWS`` counts, each a
sparse matrix of sources by terms in one task.  A source and another differ by what they
differ in where the other one has no counts, plus what changes where it has: both are
``np.add.reduceat`` over stored counts, so absent ones cost nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from pulsegrid.llm.skew import met
from pulsegrid.llm.storage import dropped, written
from pulsegrid.llm.text import LOWER, bounds, ragged, raw_strings, runs

RUN_BYTES = 8 << 20
BLOCK_ROWS = 200_000
LEAST_DOCUMENTS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000

#: Letters and every byte of a multi-byte character belong to terms, digits do not.
TERM_BYTE = np.zeros(256, bool)
TERM_BYTE[0x61:0x7B] = TERM_BYTE[0x80:] = True


def grouped_slices(low: np.ndarray, starts: np.ndarray, stops: np.ndarray, digest=xxhash.xxh3_64_intdigest) -> tuple[np.ndarray, np.ndarray]:
    """A number for every slice, equal where the bytes are, and the first slice of each."""
    raw = low.tobytes()
    hashes = np.fromiter((digest(raw[a:b]) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)), np.uint64, len(starts))
    _, first, term = np.unique(hashes, return_index=True, return_inverse=True)
    term, size = term.reshape(-1), stops - starts
    model = first[term]
    wrong = size != size[model]
    same = np.flatnonzero(~wrong)
    differ = low[ragged(starts[same], size[same])] != low[ragged(starts[model[same]], size[same])]
    if differ.any():
        wrong[same[np.unique(np.repeat(np.arange(len(same)), size[same])[differ])]] = True
    firsts, known = first.tolist(), {}
    for k in np.flatnonzero(wrong).tolist():
        key = raw[starts[k] : stops[k]]
        if key not in known:
            known[key] = len(firsts)
            firsts.append(k)
        term[k] = known[key]
    return term, np.array(firsts, np.int64)


def matrix(term: np.ndarray, n_terms: int, doc: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of counts of a run: group, term, occurrences, documents.  ``doc`` is the
    document of each occurrence, ``group`` the group of each document."""
    pair, n = np.unique(doc * n_terms + term, return_counts=True)
    cell = group[pair // n_terms] * n_terms + pair % n_terms
    order = np.argsort(cell, kind="stable")
    cell, n = cell[order], n[order]
    begin = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
    total = np.add.reduceat(n, begin) if len(begin) else n
    return cell[begin] // n_terms, cell[begin] % n_terms, total, np.diff(np.append(begin, len(cell)))


def _long_text(low: np.ndarray, limit: int) -> tuple[list[bytes], list[int]]:
    """Terms and counts of one text, looked at in stretches of about ``limit`` bytes."""
    starts, stops = bounds(TERM_BYTE[low], np.array([0, len(low)]))
    counts: dict[bytes, int] = {}
    k = 0
    while k < len(starts):
        j = max(k + 1, int(np.searchsorted(starts, starts[k] + limit)))
        part = low[starts[k] : stops[j - 1]]
        a, b = starts[k:j] - starts[k], stops[k:j] - starts[k]
        term, first = grouped_slices(part, a, b)
        raw = part.tobytes()
        for f, n in zip(first.tolist(), np.bincount(term, minlength=len(first)).tolist(), strict=True):
            counts[key] = counts.get(key := raw[a[f] : b[f]], 0) + n
        k = j
    return list(counts), list(counts.values())


def term_counts(docs: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` and ``docs`` (documents with the term)."""

    def record(lang, source, terms, n, in_docs):
        return pa.RecordBatch.from_arrays([lang, source, terms, pa.array(n, pa.int64()), pa.array(in_docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    def one(batches):
        for batch in batches:
            lang, source = (batch.column(k).dictionary_encode() for k in (1, 2))
            data, offsets = raw_strings(batch.column(0))
            code = lang.indices.to_numpy().astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy()
            for i, j in runs(offsets, run_bytes):
                low = LOWER[data[offsets[i] : offsets[j]]]
                if j - i == 1 and len(low) > run_bytes:
                    terms, n = _long_text(low, run_bytes)
                    of = np.full(len(terms), i)
                    yield record(batch.column(1).take(of), batch.column(2).take(of), pa.array(terms, pa.binary()).cast(pa.string()), n, np.ones(len(n), np.int64))
                    continue
                at = offsets[i : j + 1] - offsets[i]
                starts, stops = bounds(TERM_BYTE[low], at)
                term, first = grouped_slices(low, starts, stops)
                doc = np.searchsorted(at, starts, "right") - 1
                groups, group = np.unique(code[i:j], return_inverse=True)
                row, col, n, in_docs = matrix(term, max(1, len(first)), doc, group.reshape(-1))
                raw = low.tobytes()
                names = pa.array([raw[a:b] for a, b in zip(starts[first].tolist(), stops[first].tolist(), strict=True)], pa.binary()).cast(pa.string())
                langs, sources = np.divmod(groups[row], max(1, len(source.dictionary)))
                yield record(lang.dictionary.take(pa.array(langs)), source.dictionary.take(pa.array(sources)), names.take(pa.array(col)), n, in_docs)

    return docs.select("text", "lang", "source").mapInArrow(one, "lang string, source string, term string, n long, docs long")


def share(n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE (n + 1) / whole), three digits at a time, as products would overflow."""
    out, rest = np.divmod(n + 1, whole)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, whole)
        out = out * 1000 + more
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def block_divergence(row: np.ndarray, term: np.ndarray, n: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """Sums over the terms of a block for every pair (source, other source).

    ``row``, ``term``, ``n`` are the counts, ``row`` ascending; ``whole`` is the divisor of
    each source."""
    size = len(whole)
    n_terms = int(term.max(initial=-1)) + 1
    p, none = share(n, whole[row]), share(np.zeros(size, np.int64), whole)
    begin = np.searchsorted(row, np.arange(size))
    held = np.diff(np.append(begin, len(row)))
    live = np.flatnonzero(held)
    out = np.zeros((size, size), np.int64)
    for g in range(size):
        own = p[begin[g] : begin[g] + held[g]]
        # no counts in the other source
        out[g] = (n_terms - held[g]) * distance(none[g], none)
        for h in range(size):
            out[g, h] += distance(own, none[h]).sum()
        # and what changes where it has some
        here = np.full(n_terms, none[g])
        here[term[begin[g] : begin[g] + held[g]]] = own
        change = distance(here[term], p) - distance(here[term], none[row])
        if len(live):
            out[g, live] += np.add.reduceat(change, begin[live])
    return out


def _pairs(kept: DataFrame, groups: DataFrame, n_kept: int, block_rows: int) -> DataFrame:
    """``lang``, ``source``, ``item`` (another source of the language) and ``value``."""
    per_lang = groups.groupBy("lang").agg(F.sum("rows").alias("n")).withColumn("blocks", F.greatest(F.lit(1), F.ceil(F.col("n") / block_rows)).cast("int"))
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int").alias("block")
    left = met(kept.select("lang", "source", "term", "n").withColumnRenamed("n", "count"), per_lang, ["lang"], n_kept).select("lang", block, "source", "term", "count")
    right = groups.join(per_lang.drop("n"), "lang").select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", "whole")

    def one(key, counts: pa.Table, known: pa.Table) -> pa.Table:
        known = known.sort_by("source")
        sources = known.column("source").combine_chunks()
        row = pc.index_in(counts.column("source").combine_chunks(), value_set=sources).to_numpy(zero_copy_only=False).astype(np.int64)
        term = np.unique(counts.column("term").to_numpy(), return_inverse=True)[1].reshape(-1) if len(row) else row
        order = np.argsort(row, kind="stable")
        value = block_divergence(row[order], term[order], counts.column("count").to_numpy()[order], known.column("whole").to_numpy())
        a, b = np.nonzero(~np.eye(len(sources), dtype=bool))
        columns = [pa.array([key[0].as_py()] * len(a), pa.string()), sources.take(pa.array(a)), sources.take(pa.array(b)), pa.array(value[a, b])]
        return pa.Table.from_arrays(columns, names=["lang", "source", "item", "value"])

    found = left.groupBy("lang", "block").cogroup(right.groupBy("lang", "block")).applyInArrow(one, "lang string, source string, item string, value long")
    return found.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def _share(n: str, whole: str):
    """1 + floor(SCALE (n + 1) / whole), by decimals, as products pass 64 bits."""
    return F.expr(f"1 + (cast({SCALE} as decimal(10, 0)) * cast({n} + 1 as decimal(19, 0))) div cast({whole} as decimal(19, 0))")


def audited(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, top_terms: int = TOP_TERMS, block_rows: int = BLOCK_ROWS, run_bytes: int = RUN_BYTES) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank``.

    Part ``pair``: how far the source is from each other source of the language, over all
    terms that at least ``least_documents`` documents of the language have.  Part
    ``term``: the ``top_terms`` terms that the source has more of than the language, by
    how much.  Equal values rank by item.

    Null texts, languages and sources count as empty strings; a group without terms is
    compared all the same, a language without terms gives 0.  Repeated rows count each.
    Other columns are not looked at.  An empty table gives no rows."""
    docs = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    counts = written(term_counts(docs, run_bytes).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "counts")
    terms = written(counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_documents).drop("docs"), "terms")
    kept = written(counts.drop("docs").join(terms, ["lang", "term"]), "kept")
    vocabulary = terms.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_all"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("all"), F.count("*").alias("rows"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(vocabulary, "lang", "left").fillna(0, ["all", "rows", "v", "lang_all"])
    # without terms there is nothing to divide
    whole, lang_whole = (F.greatest(F.lit(1), F.col(c) + F.col("v")).alias(name) for c, name in (("all", "whole"), ("lang_all", "lang_whole")))
    groups = written(groups.select("lang", "source", "rows", whole, lang_whole), "groups")
    dropped(counts, terms)
    n_kept = groups.agg(F.sum("rows")).first()[0] or 0

    pairs = _pairs(kept, groups, n_kept, block_rows).withColumn("part", F.lit("pair"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order))

    sized = met(kept.withColumnRenamed("n", "count"), groups.withColumnRenamed("rows", "n"), ["lang", "source"], n_kept)
    held = sized.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _share("count", "whole").alias("p"), _share("total", "lang_whole").alias("q")).where("p > q")
    more = held.select("lang", "source", "part", "item", F.expr("((p - q) * (p - q)) div q").alias("value"))
    best = more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    names = ["lang", "source", "part", "item", "value", "rank"]
    return ranked.select(*names).unionByName(best.select(*names))


def digest(docs: DataFrame, **options) -> DataFrame:
    """The audit's rows as they are: nulls count as empty strings, ties rank by item."""
    return audited(docs, **options)


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
words AS (
  SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM d),
terms AS (SELECT lang, term, count(*) AS total FROM words GROUP BY ALL HAVING count(DISTINCT id) >= {LEAST_DOCUMENTS}),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM terms GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS c FROM words SEMI JOIN terms USING (lang, term) GROUP BY ALL),
sizes AS (
  SELECT lang, source, coalesce(max(v), 0) AS v, coalesce(sum(c), 0) AS n, coalesce(max(v.n), 0) AS lang_n
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang) LEFT JOIN counts USING (lang, source) GROUP BY ALL),
shares AS (
  SELECT lang, source, term, coalesce(c, 0) AS c, (1 + {SCALE}::HUGEINT * (coalesce(c, 0) + 1) // (n + v))::HUGEINT AS p,
         (1 + {SCALE}::HUGEINT * (total + 1) // (lang_n + v))::HUGEINT AS q
  FROM sizes JOIN terms USING (lang) LEFT JOIN counts USING (lang, source, term)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::BIGINT AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every_pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM sizes a JOIN sizes b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
every_term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM shares WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM (FROM every_pair UNION ALL FROM every_term))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP_TERMS}
"""
