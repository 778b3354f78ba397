"""Operator 6: language identification by Bayesian fusion of evidence.

For each row and language l:  P(l | row)  ~  P(text | l) * P(declared | l) * P(suffix | l) * P(l | host).

* text: byte trigrams of the lower-cased text, hashed; counts by declared language come from a grouped aggregation over
  all rows. The log likelihood is averaged over the text's trigrams and weighs as much as EVIDENCE of them at most.
* declared markup language and address suffix: how often each value stands with each language that the text alone points
  to, a grouped aggregation with add-one smoothing. A missing value says nothing.
* host: a prior smoothed through the hierarchy host -> domain -> all rows, each level counting with the strength
  STRENGTH of the level above, from grouped aggregations of the languages that the texts alone point to.

The languages are all declared ones. Their trigram counts are held sparsely, and texts are scored for LANGUAGES_AT_ONCE at a time.
kept: the text has a letter or digit and the best language's probability is at least MIN_PROBABILITY. Null texts count as
empty; empty texts are decided by the other evidence, and not kept. A table in which no row declares a language gives null
languages, probability 0 and keeps nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written
from .word_ids import lean

SLOTS = 1 << 16
LANGUAGES_AT_ONCE = 64
_ENTRIES_AT_ONCE = 1 << 22
EVIDENCE = 80
STRENGTH = 10.0
MIN_PROBABILITY = 0.5
_BYTES_AT_ONCE = 1 << 19


def _trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all trigrams, and how many each text has."""
    raw = [b" " + t.lower().encode() + b" " if t else b"" for t in texts]
    x = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint32)
    n = np.array([len(r) for r in raw], np.int64)
    if len(x) < 3:
        return np.zeros(0, np.uint16), np.zeros(len(raw), np.int64)
    h = ((x[:-2] * np.uint32(0x9E3779B1)) ^ (x[1:-1] * np.uint32(0x85EBCA6B)) ^ (x[2:] * np.uint32(0xC2B2AE35))) * np.uint32(0x27D4EB2F) >> np.uint32(16)
    inside = np.ones(len(x), bool)
    ends = np.cumsum(n)[n > 0]
    inside[ends - 1] = inside[ends - 2] = False
    return h.astype(np.uint16)[inside[:-2]], np.maximum(n - 2, 0)


def _texts(batch, names: list[str]):
    """Column lists with about _BYTES_AT_ONCE of text each."""
    columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
    at = 0
    while at < batch.num_rows:
        size, end = 0, at
        while end < batch.num_rows and size < _BYTES_AT_ONCE:
            size += len(columns[-1][end].as_py() or "")
            end += 1
        yield [c.slice(at, end - at).to_pylist() for c in columns]
        at = end


def languages(rows: DataFrame) -> list[str]:
    return sorted(r.declared for r in rows.where("declared is not null").select("declared").distinct().collect())


def train(rows: DataFrame, known: list[str]) -> list[tuple]:
    """By LANGUAGES_AT_ONCE languages: log P of slots not met, by language; slots met, their language and log P."""
    place = {l: k for k, l in enumerate(known)}

    def run(batches):
        def merged(keys, counts):
            keys, at = np.unique(np.concatenate(keys), return_inverse=True)
            return [keys], [np.bincount(at, np.concatenate(counts)).astype(np.int64)]

        keys, counts = [], []
        for batch in batches:
            for declared, texts in _texts(batch, ["declared", "text"]):
                slots, n = _trigrams(texts)
                language = np.repeat(np.array([place[d] for d in declared], np.int64), n)
                found, times = np.unique(language * SLOTS + slots, return_counts=True)
                keys.append(found)
                counts.append(times)
                if len(keys) > 1 and sum(map(len, keys[1:])) > max(_ENTRIES_AT_ONCE, len(keys[0])):
                    keys, counts = merged(keys, counts)
        if keys:
            (keys,), (counts,) = merged(keys, counts)
            for at in range(0, len(keys), SLOTS):
                some = keys[at : at + SLOTS]
                yield pa.RecordBatch.from_arrays([pa.array((some // SLOTS).astype(np.int32)), pa.array((some % SLOTS).astype(np.int32)), pa.array(counts[at : at + SLOTS])], ["l", "slot", "n"])

    found = rows.where("declared is not null").select("declared", "text").mapInArrow(lean(run), "l int, slot int, n long").groupBy("l", "slot").agg(F.sum("n").alias("n")).toArrow()
    l, slot, n = (found.column(c).to_numpy() for c in ("l", "slot", "n"))
    whole = np.bincount(l, n, len(known)) + 0.5 * SLOTS
    out = []
    for at in range(0, len(known), LANGUAGES_AT_ONCE):
        some = (l >= at) & (l < at + LANGUAGES_AT_ONCE)
        out.append((np.log(0.5 / whole[at : at + LANGUAGES_AT_ONCE]), slot[some].astype(np.uint16), (l[some] - at).astype(np.uint8), np.log((n[some] + 0.5) / whole[l[some]]).astype("<f4")))
    return out


def _dense(group: tuple) -> np.ndarray:
    unmet, slot, l, met = group
    table = np.tile(unmet.astype("<f4"), (SLOTS, 1))
    table[slot, l] = met
    return table


def likelihoods(rows: DataFrame, groups: list[tuple]) -> DataFrame:
    """rows with ll, the text's log likelihood by language, and has_text instead of the text."""
    rest = [f for f in rows.schema if f.name != "text"]

    def run(batches):
        kept = [_dense(groups[0])] if len(groups) == 1 else None
        for batch in batches:
            at = 0
            for (texts,) in _texts(batch, ["text"]):
                slots, n = _trigrams(texts)
                sums = np.zeros((len(texts), sum(len(g[0]) for g in groups)))
                if len(slots):
                    first = 0
                    for table in kept or map(_dense, groups):
                        sums[n > 0, first : first + table.shape[1]] = np.add.reduceat(table[slots], (np.cumsum(n) - n)[n > 0], axis=0)
                        first += table.shape[1]
                ll = sums / np.maximum(n, 1)[:, None] * np.minimum(n, EVIDENCE)[:, None]
                part = batch.slice(at, len(texts))
                at += len(texts)
                has = pa.array([any(c.isalnum() for c in (t or "")[:200]) or any(c.isalnum() for c in t or "") for t in texts])
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index(f.name)) for f in rest] + [pa.array(ll.tolist(), pa.list_(pa.float64())), has], [f.name for f in rest] + ["ll", "has_text"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest)
    return rows.select(*[F.col(f.name) for f in rest], "text").mapInArrow(lean(run), f"{fields}, ll array<double>, has_text boolean")


def _argmax(a: Column) -> Column:
    return F.array_position(a, F.array_max(a)).cast("int")


def identify(rows: DataFrame) -> DataFrame:
    """rows (text, declared, suffix, host, domain and others) without the text, with language, probability, text_language and kept."""
    known = languages(rows)
    if not known:
        gone = rows.drop("text")
        return gone.withColumns({"language": F.lit(None).cast("string"), "probability": F.lit(0.0), "text_language": F.lit(None).cast("string"), "kept": F.lit(False)})
    own = [f.name for f in rows.schema if f.name != "text"]
    scored = written(likelihoods(rows, train(rows, known)), "likelihoods").withColumn("points_to", F.when(F.col("has_text"), _argmax(F.col("ll"))))
    size = len(known)

    def by(name):
        full = scored.where("points_to is not null").where(F.col(name).isNotNull()).groupBy(name, "points_to").count()
        full = full.groupBy(F.col(name).alias(f"k_{name}")).agg(F.map_from_entries(F.collect_list(F.struct("points_to", F.col("count").cast("double")))).alias("__counts"))
        places = F.sequence(F.lit(1), F.lit(size))
        return full.select(f"k_{name}", F.transform(places, lambda k: F.coalesce(F.try_element_at(F.col("__counts"), k), F.lit(0.0))).alias(f"n_{name}"))

    total = np.ones(size)  # rows that point to each language, and one
    for r in scored.where("points_to is not null").groupBy("points_to").count().collect():
        total[r.points_to - 1] += r["count"]
    prior = F.array(*[F.lit(float(p)) for p in total / total.sum()])

    def smoothed(n: Column, above: Column) -> Column:
        """The level's shares, counting with STRENGTH rows of the level above."""
        return F.when(n.isNull(), above).otherwise(F.zip_with(n, above, lambda c, p: (c + STRENGTH * p) / (F.aggregate(n, F.lit(0.0), lambda s, v: s + v) + STRENGTH)))

    def said(n: Column) -> Column:
        """log P(value | language) but for the constant that all values share; 0 where nothing is said."""
        return F.when(n.isNull(), F.array_repeat(F.lit(0.0), size)).otherwise(F.zip_with(n, F.array(*[F.lit(float(t)) for t in total]), lambda c, t: F.log((c + 1) / (t + 1))))

    fused = scored
    for name in ("declared", "suffix", "host", "domain"):
        fused = fused.join(by(name), F.col(name) == F.col(f"k_{name}"), "left").drop(f"k_{name}")
    fused = fused.withColumn("__prior", smoothed(F.col("n_domain"), prior)).withColumn("__prior", smoothed(F.col("n_host"), F.col("__prior")))
    logs = F.zip_with(F.zip_with("ll", F.transform("__prior", lambda p: F.log(p)), lambda a, b: a + b), F.zip_with(said(F.col("n_declared")), said(F.col("n_suffix")), lambda a, b: a + b), lambda a, b: a + b)
    fused = fused.withColumn("__logs", logs).withColumn("__best", F.array_max("__logs"))
    probability = 1 / F.aggregate("__logs", F.lit(0.0), lambda s, v: s + F.exp(v - F.col("__best")))
    names = F.array(*[F.lit(l) for l in known])
    return fused.select(
        *own,
        F.element_at(names, F.array_position("__logs", F.col("__best")).cast("int")).alias("language"),
        probability.alias("probability"),
        F.when(F.col("points_to").isNotNull(), F.element_at(names, F.coalesce("points_to", F.lit(1)))).alias("text_language"),
        (F.col("has_text") & (probability >= MIN_PROBABILITY)).alias("kept"),
    )


def declared_language(c: Column) -> Column:
    """The language of a tag (en of en-US), lower-cased; NULL where nothing is declared."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), "[-_].*$", ""), F.lit(""))


def from_documents(docs: DataFrame) -> DataFrame:
    """Evidence of documents: lang is the declared language, source the host."""
    none = F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.lit(None).cast("long").alias("page_id"), declared_language(F.col("lang")).alias("declared"), none.alias("suffix"), F.col("source").cast("string").alias("host"), F.col("source").cast("string").alias("domain"), F.col("text").cast("string"))


def from_pages(pages: DataFrame) -> DataFrame:
    """Evidence of web pages: the html element's lang, the address's language segment or else top-level domain, host and domain."""
    html, url = F.coalesce("html", F.lit("")), F.coalesce("url", F.lit(""))
    blank = lambda c: F.when(c != "", F.lower(c))
    host = F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    segment = F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://[^/?#]+/([A-Za-z]{2})(?:[/?#]|$)", 1)
    text = F.regexp_replace(html, r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<[^>]*>", " ")
    return pages.select(
        F.lit(None).cast("long").alias("doc_id"), F.col("page_id").cast("long"),
        blank(F.regexp_extract(html, r"""(?i)<html\b[^>]*?\slang\s*=\s*["']?([A-Za-z]{2,3})""", 1)).alias("declared"),
        F.coalesce(F.concat(F.lit("/"), blank(segment)), F.concat(F.lit("."), blank(F.regexp_extract(host, r"\.([A-Za-z]+)$", 1)))).alias("suffix"),
        blank(host).alias("host"), blank(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias("domain"),
        F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text"),
    )
