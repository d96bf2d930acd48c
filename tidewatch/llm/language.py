"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are combined for each document:

* the text: character trigrams under each language's model (and under a uniform one, for what is no language), whose
  log likelihood counts by ``TEMPER`` as neighbouring trigrams tell the same thing twice;
* the host's prior: shares of languages among the host's texts, smoothed to those of its address suffix, which are
  smoothed to those of all, all from grouped sums over every document;
* the declared language (the page's markup, or the table's column): how often texts that declare it are in
  each language, from a grouped sum too.

log posterior = TEMPER * text + log P(l | host) + log P(l | declared) - log P(l).

Each declared language has a trigram model, fitted to at most ``PER_LANGUAGE`` of its texts, a piece of
``LONGEST`` characters of those that are longer; the trigrams are counted by a grouped sum.  Everything else uses all rows.  A document is
kept if the languages together reach ``SURE`` and the best is not the uniform model (``und``): one that mixes two languages is kept,
whichever wins.  For a document that declares a language without a model (no text of it has a letter) the uniform
model stands for that language: where it wins, the declaration is what is left to go by.

Edge cases: a null, empty or letterless text is ``und`` and not kept; a null declared language, suffix or host is a group of its own;
texts are read whole, however long; of languages equally probable the first by name is taken; repeated rows each get a row; extra columns
are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import are_few, cut, join_by_group, lowest, own_columns, rate_limit, row_key, rows_again, with_row

PER_LANGUAGE, LONGEST = 800, 20_000
BITS = 15
TEMPER = 0.25
UNSEEN = 0.05
SURE = 0.6
#: How many documents' worth the coarser level counts in the finer one.
KAPPA = 20.0
UND = "und"
REMEMBERED = 200_000
#: Numbers that remembered words may take together, and those of a block of words.
ROOM, BLOCK_ROOM = 16_000_000, 4_000_000
WORD = re.compile(r"[^\W\d_]+")


def trigrams(word: str) -> list[int]:
    w = f" {word} "
    return [zlib.crc32(w[i : i + 3].encode()) >> (32 - BITS) for i in range(len(w) - 2)]


class TextModel:
    """Log likelihoods of words in each language; the last column is the uniform model."""

    def __init__(self, languages: list[str], table: np.ndarray) -> None:
        self.languages, self.table = languages, table
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, table.shape[1]), np.float32)
        self.most = min(REMEMBERED, max(1, ROOM // table.shape[1]))
        self.block = min(50_000, max(1, BLOCK_ROOM // table.shape[1]))

    def row(self, word: str) -> int:
        if len(self.known) >= self.most:
            self.known.clear()
        k = self.known[word] = len(self.known)
        if k >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[k] = self.table[trigrams(word)].sum(0)
        return k

    def likelihoods(self, text: str) -> tuple[int, np.ndarray]:
        """Number of words, and the text's log likelihood in each language."""
        total = np.zeros(self.table.shape[1])
        n = 0
        words = WORD.findall(text.lower())
        for start in range(0, len(words), self.block):
            block = words[start : start + self.block]
            fresh = [w for w in set(block) if w not in self.known]
            if len(self.known) + len(fresh) >= self.most:
                self.known.clear()
                fresh = list(set(block))
            for w in fresh:
                self.row(w)
            index = np.fromiter((self.known[w] for w in block), np.int64, len(block))
            total += self.rows[index].sum(0, dtype=np.float64)
            n += len(block)
        return n, total


def _piece(*by: str) -> Column:
    """The text, or of one longer than ``LONGEST`` that many characters from a place chosen by hash, runs of what is no letter as one space."""
    letters = F.regexp_replace("text", r"[^\p{L}]+", " ")
    start = F.pmod(F.xxhash64(*by, F.lit("piece")), F.greatest(F.length(letters) - LONGEST + 1, F.lit(1))).cast("int") + 1
    return F.when(F.length("text") > LONGEST, F.substring(letters, start, F.lit(LONGEST))).otherwise(F.col("text"))


def _limited(docs: DataFrame, limits: dict[str, int], *by: str) -> DataFrame:
    """The rows of ``docs`` of each language whose hash is below the language's limit."""
    table = docs.sparkSession.createDataFrame(sorted(limits.items()), "declared string, _limit bigint")
    return lowest(docs.join(F.broadcast(table), "declared"), F.col("_limit"), *by)


def _sample(docs: DataFrame, counts: dict[str, int], *by: str) -> DataFrame:
    """declared and the text, or a piece of it, of ``PER_LANGUAGE`` of ``docs`` of each language in ``counts``, those that hash lowest."""
    some = _limited(docs.where(F.col("text").isNotNull()), {name: rate_limit(n, PER_LANGUAGE) for name, n in counts.items()}, *by)
    some = cut(some.select("declared", "_low", _piece(*by).alias("text")))
    got = some.select("declared", "_low").toArrow()  # numbers of some 1250 rows of a language
    hashes: dict[str, list[int]] = {}
    for name, low in zip(got["declared"].to_pylist(), got["_low"].to_pylist()):
        hashes.setdefault(name, []).append(low)
    last = {name: sorted(all_)[:PER_LANGUAGE][-1] for name, all_ in hashes.items()}
    table = docs.sparkSession.createDataFrame(sorted(last.items()), "declared string, _last bigint")
    return some.join(F.broadcast(table), "declared").where("_low <= _last").select("declared", "text")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """declared, trigram (-1: texts with a letter) and count of each batch of declared and text."""
    for b in batches:
        counts: dict[tuple[str, int], int] = {}
        for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            words = WORD.findall(text.lower())
            for t in ([-1] if words else []) + [t for w in words for t in trigrams(w)]:
                counts[name, t] = counts.get((name, t), 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in counts], pa.string()), pa.array([t for _, t in counts], pa.int32()), pa.array(counts.values(), pa.int64())], ["declared", "t", "n"])


def _trigrams_of(sample: DataFrame) -> dict[str, tuple[np.ndarray, int]]:
    """The counts of trigrams of each language in ``sample``, and how many of its texts have any."""
    got = sample.mapInArrow(_counted, "declared string, t int, n bigint").groupBy("declared", "t").agg(F.sum("n").alias("n")).toArrow()
    names, at, n = np.array(got["declared"].to_pylist(), object), got["t"].to_numpy(), got["n"].to_numpy()
    found: dict[str, tuple[np.ndarray, int]] = {}
    order = np.argsort(names, kind="stable")
    names, at, n = names[order], at[order], n[order]
    starts = [k for k in range(len(names)) if k == 0 or names[k] != names[k - 1]]
    for a, b in zip(starts, [*starts[1:], len(names)]):
        count = np.zeros(1 << BITS)
        count[at[a:b][at[a:b] >= 0]] = n[a:b][at[a:b] >= 0]
        found[names[a]] = count, int(n[a:b][at[a:b] < 0].sum())
    return found


def fit_text(docs: DataFrame, *by: str) -> TextModel:
    """Trigram models of all declared languages, each from a bounded sample of ``docs`` (text, declared), chosen by the hash of the columns ``by``."""
    declared = docs.where(F.col("declared").isNotNull() & (F.col("declared") != UND))
    enough = lambda rows: {r["declared"]: r["n"] for r in rows.groupBy("declared").agg(F.count("*").alias("n")).collect()}  # noqa: E731  a row for each declared code
    counts = enough(declared)
    found = _trigrams_of(_sample(declared, counts, *by)) if counts else {}
    # Where many of a language's texts are null or without a letter, few were in its sample: those with one are counted and sampled again.
    few = [name for name, n in counts.items() if n > PER_LANGUAGE and found.get(name, (None, 0))[1] < PER_LANGUAGE]
    if few:
        lettered = declared.where(F.col("text").rlike(r"\p{L}")).join(F.broadcast(docs.sparkSession.createDataFrame([(name,) for name in sorted(few)], "declared string")), "declared")
        again = enough(lettered)
        found = {name: got for name, got in found.items() if name not in few} | (_trigrams_of(_sample(lettered, again, *by)) if again else {})
    languages = sorted(name for name, (count, _) in found.items() if count.any())
    table = np.full((1 << BITS, len(languages) + 1), -np.log(1 << BITS), np.float32)
    for k, name in enumerate(languages):
        count = found[name][0]
        # A share of the uniform model in each, so that a few unseen trigrams (of a code or a name) do not make a text no language.
        table[:, k] = np.log((1 - UNSEEN) * count / count.sum() + UNSEEN / (1 << BITS))
    return TextModel(languages, table)


def posteriors(docs: DataFrame, keys: tuple[str, ...], model: TextModel) -> DataFrame:
    """``keys``, declared, suffix and host of each row, with n (words) and ll (tempered log likelihoods, such that their exponentials sum to 1)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.table))
    keep = [*keys, "declared", "suffix", "host"]
    n_kept = len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = TextModel(*shared.value)
        for b in batches:
            got = [own.likelihoods(t.as_py() or "") for t in b.column(n_kept)]
            ll = [(v - np.log(np.exp(v).sum())).tolist() for v in (TEMPER * (v - v.max()) for _, v in got)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n_kept], pa.array([n for n, _ in got], pa.int64()), pa.array(ll, pa.list_(pa.float64()))], [*keep, "n", "ll"])

    return docs.select(*keep, "text").mapInArrow(run, ", ".join(f"{k} bigint" for k in keys) + ", declared string, suffix string, host string, n bigint, ll array<double>")


def _shares(sums: list[Column], coarser: list[Column], total: Column) -> list[Column]:
    return [(s + KAPPA * c) / (total + KAPPA) for s, c in zip(sums, coarser)]


def identify(docs: DataFrame, *keys: str) -> DataFrame:
    """The columns ``keys`` (else doc_id), declared, lang_pred, confidence, kept and n_words for each row of ``docs`` (keys, text, declared, suffix, host)."""
    keys = keys or ("doc_id",)
    docs = docs.select(*[F.col(k).cast("bigint").alias(k) for k in keys], "text", *[F.col(c).cast("string").alias(c) for c in ("declared", "suffix", "host")])
    model = fit_text(docs, *keys, "text")
    names = [*model.languages, UND]
    rng = range(len(names))
    rows = cut(posteriors(docs, keys, model))
    soft = rows.where("n > 0").select("declared", "suffix", "host", *[F.exp(F.col("ll")[i]).alias(f"p{i}") for i in rng])
    sums = [F.sum(f"p{i}").alias(f"s{i}") for i in rng]
    everything = soft.agg(*sums, F.count("*").alias("m")).first()
    whole = [((everything[i] or 0.0) + 1.0) / ((everything["m"] or 0) + len(names)) for i in rng]
    overall = [F.lit(w) for w in whole]
    by_suffix = soft.groupBy("suffix").agg(*sums, F.count("*").alias("m"))
    by_suffix = cut(by_suffix.select("suffix", F.array(*_shares([F.col(f"s{i}") for i in rng], overall, F.col("m"))).alias("of_suffix")))
    by_host = cut(soft.groupBy("host", "suffix").agg(*sums, F.count("*").alias("m")))
    by_host = join_by_group(by_host, by_suffix, "suffix", "host")
    by_host = by_host.select("host", F.array(*_shares([F.col(f"s{i}") for i in rng], [F.col("of_suffix")[i] for i in rng], F.col("m"))).alias("of_host"), F.col("m"))
    by_host = cut(by_host.groupBy("host").agg(F.max_by("of_host", "m").alias("of_host")))  # a host has one suffix
    by_declared = soft.groupBy("declared").agg(*sums, F.count("*").alias("m"))
    by_declared = cut(by_declared.select("declared", F.array(*_shares([F.col(f"s{i}") for i in rng], overall, F.col("m"))).alias("of_declared")))
    out = join_by_group(rows, by_host, "host", keys[-1])
    out = join_by_group(out, by_declared, "declared", keys[-1])
    flat = F.lit(whole)
    log = F.zip_with(F.zip_with("ll", F.transform(F.coalesce("of_host", flat), lambda p: F.ln(p)), lambda a, b: a + b), F.transform(F.zip_with(F.coalesce("of_declared", flat), flat, lambda p, q: p / q), lambda p: F.ln(p)), lambda a, b: a + b)
    out = out.withColumn("_log", log).withColumn("_max", F.array_max("_log"))
    best = F.element_at(F.lit(names), F.array_position("_log", F.col("_max")).cast("int"))
    out = out.withColumn("confidence", 1 / F.aggregate(F.transform("_log", lambda x: F.exp(x - F.col("_max"))), F.lit(0.0), lambda a, x: a + x))
    unmodelled = F.coalesce(F.col("declared") != UND, F.lit(False)) & ~F.array_contains(F.lit(names), F.coalesce("declared", F.lit(UND)))
    known = F.when(unmodelled, 1.0).otherwise(1 - F.col("confidence") * F.exp(F.element_at("_log", -1) - F.col("_max")))
    out = out.withColumn("lang_pred", F.when(F.col("n") == 0, F.lit(UND)).when(unmodelled & (best == UND), F.col("declared")).otherwise(best))
    kept = (F.col("n") > 0) & (F.col("lang_pred") != UND) & (known >= SURE)
    return out.select(*keys, "declared", "lang_pred", "confidence", kept.alias("kept"), F.col("n").alias("n_words"))


def of_documents(docs: DataFrame) -> DataFrame:
    """Columns that ``identify`` takes, from the documents table: its lang is declared, its source is the host."""
    own = own_columns(docs, ("doc_id", "text", "lang", "source"))
    code = F.lower(F.regexp_extract(F.col("lang"), "^[A-Za-z]{2,3}", 0))
    return own.select("doc_id", "text", F.when(code != "", code).alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"))


def of_pages(pages: DataFrame) -> DataFrame:
    """The same from web pages: the markup's lang attribute, the address's suffix and host, the text between the tags."""
    pages = own_columns(pages, ("page_id", "url", "html"))
    html = F.coalesce("html", F.lit(""))
    tag = F.regexp_extract(html, r"(?i)<html\b[^>]*+>?", 0)  # the first, whatever its length
    code = F.lower(F.regexp_extract(tag, r"(?i)\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*+>.*?</\1\s*>", " "), "<[^>]*+>", " ")
    return pages.select("page_id", text.alias("text"), F.when(code != "", code).alias("declared"), F.nullif(F.substring_index(host, ".", -1), F.lit("")).alias("suffix"), F.nullif(host, F.lit("")).alias("host"))


def keep(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is known, all columns; ``lang`` becomes the language told where that is not the one declared.

    Rows alike in id and text share their fate: they go if one of them is to go, and of several new languages the first by name is taken.  Only what
    changes is joined to the texts, which move only if that is more than may be broadcast.
    """
    told = identify(of_documents(docs).withColumn("key", row_key()), "doc_id", "key")
    changes = told.where(~F.col("kept") | ~F.col("lang_pred").eqNullSafe(F.col("declared")))
    changes = cut(changes.groupBy("doc_id", "key").agg(F.bool_and("kept").alias("_kept"), F.min("lang_pred").alias("_new")))
    changes = changes.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k"), "_kept", "_new")
    rows = with_row(docs, ("doc_id", "text", "lang")).select("_row", "doc_id", "lang", row_key().alias("_key"))
    out = rows.join(F.broadcast(changes) if are_few(changes) else changes, (F.col("_key") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left")
    return rows_again(out.where(F.coalesce("_kept", F.lit(True))), docs.columns, {"lang": F.coalesce("_new", "lang")})
