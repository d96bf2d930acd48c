"""Personal data: expressions propose spans, checksums confirm them, words nearby adjust the score.

DataFrame functions only.  A kind's expression is run twice over the whole text, once for the
matches and once for what lies between them; the lengths of both give the positions, in code
points.  Base kinds (email, ip, card, phone) are kept whenever their own test holds, whatever their score; extra kinds (iban, by the
mod-97 checksum, and ssn) only from ``THRESHOLD`` on, which an ssn reaches only with a word that speaks of it nearby.

The expressions are written so that no text makes them slow: possessive where the next character cannot
belong to the loop, and anchored to the start of a run or the end of the last match.

Edge cases: a null text counts as empty, which has no spans; repeated rows each get a row; a null doc_id stays
null; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own_columns, rows_again, with_row

THRESHOLD = 0.7
#: Code points before and after a span in which words are looked for.
NEARBY = 48
#: Matches of a text handled at once, so that long lists are not copied for each match, and how many of those after one may
#: begin within ``NEARBY``, as none is shorter than two code points.
BLOCK, AHEAD = 256, NEARBY // 2
_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
HIT = "struct<start:int,end:int,hit:string,near:string>"

#: kind: expression, what a matching text must contain, words that raise the score, score without them.
BASE: dict[str, tuple[str, str, str, float]] = {
    "email": (rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++", "@", "mail|contact|write|schreib|correo|courriel", 0.9),
    "ip": (r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", r"\bip\b|host|address|login|server", 0.6),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", "", "card|visa|master|amex|credit|payment|karte|carte|tarjeta", 0.8),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+", "phone|call|tel|mobile|fax|whatsapp|anruf", 0.6),
}
EXTRA: dict[str, tuple[str, str, str, float]] = {
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", "", "iban|konto|account|bank|cuenta|compte", 0.8),
    "ssn": (r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", "-", "ssn|social security|tax id", 0.4),
}
KINDS = [*BASE, *EXTRA]


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _mod97(hit: Column) -> Column:
    """The remainder of an IBAN's number: the first four characters go last, letters count from 10."""
    flat = F.regexp_replace(hit, " ", "")
    turned = F.concat(F.substring(flat, 5, 64), F.substring(flat, 1, 4))
    step = lambda acc, c: F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(step(acc, c)))


CONFIRM: dict[str, Callable[[Column], Column]] = {
    "email": lambda hit: F.lit(True),
    "ip": lambda hit: hit.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})(?:\.|$)){4}$"),
    "card": lambda hit: F.length(_digits(hit)).between(12, 19) & F.call_function("luhn_check", _digits(hit)),
    "phone": lambda hit: F.length(_digits(hit)).between(9, 15),
    "iban": lambda hit: (F.length(F.regexp_replace(hit, " ", "")).between(15, 34)) & (_mod97(hit) == 1),
    "ssn": lambda hit: ~hit.rlike("^(?:000|666|9)|-00-|-0000$"),
}


def _located(gaps: Column, hits: Column, kind: str) -> Column:
    """The confirmed matches of a kind with their positions and surroundings, other matches among them."""
    pairs = F.arrays_zip(gaps.alias("gap"), hits.alias("hit"))
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / BLOCK).cast("int")),
        lambda b: F.slice(pairs, b * BLOCK + 1, BLOCK + AHEAD),
    )
    first = lambda c: F.left(F.coalesce(c, F.lit("")), F.lit(NEARBY))
    last = lambda *cs: F.right(F.concat(*cs), F.lit(NEARBY))

    def block(acc: Column, ps: Column) -> Column:
        def one(acc: Column, p: Column) -> Column:
            start = acc["pos"] + F.length(p["gap"])
            end = start + F.length(p["hit"])
            # The code points before this match and the next are carried along, those after are put together for what is confirmed.
            after = F.array_join(F.transform(F.slice(ps, acc["k"] + 2, AHEAD), lambda q: F.concat(first(q["gap"]), first(q["hit"]))), "")
            near = F.concat(last(acc["tail"], p["gap"]), F.lit(" "), first(after))
            new = F.array(F.struct(start.alias("start"), end.alias("end"), p["hit"].alias("hit"), near.alias("near")))
            out = F.when(F.coalesce(CONFIRM[kind](p["hit"]), F.lit(False)), F.concat(acc["out"], new)).otherwise(acc["out"])
            return F.struct(end.alias("pos"), last(acc["tail"], p["gap"], p["hit"]).alias("tail"), (acc["k"] + 1).alias("k"), out.alias("out"))

        start = F.struct(acc["pos"].alias("pos"), acc["tail"].alias("tail"), F.lit(0).alias("k"), F.array().cast(f"array<{HIT}>").alias("out"))
        done = F.aggregate(F.filter(F.slice(ps, 1, BLOCK), lambda p: p["hit"].isNotNull()), start, one)
        return F.struct(done["pos"].alias("pos"), done["tail"].alias("tail"), F.concat(acc["out"], F.array(done["out"])).alias("out"))

    zero = F.struct(F.lit(0).alias("pos"), F.lit("").alias("tail"), F.array().cast(f"array<array<{HIT}>>").alias("out"))
    return F.flatten(F.aggregate(blocks, zero, block)["out"])


def _scored(rank: int, kind: str) -> Callable[[Column], Column]:
    _, _, words, score = (BASE | EXTRA)[kind]

    def span(h: Column) -> Column:
        total = F.when(F.lower(h["near"]).rlike(words), F.lit(min(1.0, score + 0.3))).otherwise(F.lit(score))
        return F.struct(h["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), h["end"].alias("end"), total.alias("score"), F.lit(kind in BASE).alias("base"))

    return span


def spans(docs: DataFrame) -> DataFrame:
    """``docs`` with a column ``found``: the spans (start, rank, kind, end, score, base) of each text, ordered by start and kind."""
    out = docs.withColumn("_text", F.coalesce("text", F.lit("")))
    none = F.array().cast("array<string>")
    for kind, (pattern, must, _, _) in (BASE | EXTRA).items():
        hits = F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))
        out = out.withColumn(f"_{kind}", F.when(F.contains("_text", F.lit(must)), hits).otherwise(none) if must else hits)
    for kind, (pattern, _, _, _) in (BASE | EXTRA).items():
        gaps = F.split("_text", pattern, -1)
        out = out.withColumn(f"_{kind}", F.when(F.size(f"_{kind}") > 0, _located(gaps, F.col(f"_{kind}"), kind)).otherwise(F.array().cast(f"array<{HIT}>")))
    ranked = [F.transform(f"_{kind}", _scored(rank, kind)) for rank, kind in enumerate(KINDS)]
    found = F.filter(F.array_sort(F.concat(*ranked)), lambda s: s["base"] | (s["score"] >= THRESHOLD))
    return out.withColumn("found", found).drop("_text", *[f"_{k}" for k in KINDS])


def _joined(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, spans and scores for each row."""
    got = spans(own_columns(docs, ("doc_id", "text"))).select("doc_id", "found")
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    scores = F.array_join(F.transform("found", lambda s: F.format_number(s["score"], 2)), ",")
    return got.select(
        "doc_id", *[count(k) for k in BASE], F.sha2(_joined(F.filter("found", lambda s: s["base"])), 256).alias("base_sha256"),
        _joined(F.col("found")).alias("spans"), scores.alias("scores"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each found span of ``text`` replaced by its kind in brackets; ``n_chars`` follows.

    Of spans that overlap, the stretch they cover together becomes one mark, of the kind that starts first.
    """
    out = spans(with_row(docs, ("text", "n_chars")))

    def merge(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        joint = F.size(acc) > 0
        joint = joint & (s["start"] < last["end"])
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))
        new = F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
        return F.when(joint, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(acc, F.array(new)))

    out = out.withColumn("_m", F.aggregate("found", F.array().cast("array<struct<start:int,end:int,kind:string>>"), merge))
    before = F.concat(F.array(F.lit(0)), F.transform("_m", lambda s: s["end"]))
    kept = F.zip_with("_m", F.slice(before, 1, F.size("_m")), lambda s, e: F.concat(F.substring(F.col("text"), e + 1, s["start"] - e), F.lit("["), F.upper(s["kind"]), F.lit("]")))
    end = F.element_at("_m", -1)["end"]
    text = F.when(F.size("_m") > 0, F.concat(F.array_join(kept, ""), F.substring(F.col("text"), end + 1, F.length("text")))).otherwise(F.col("text"))
    n = F.when(F.size("_m") > 0, F.length(text).cast("bigint")).otherwise(F.col("n_chars"))
    return rows_again(out, docs.columns, {"text": text, "n_chars": n})
