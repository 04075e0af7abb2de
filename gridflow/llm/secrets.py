"""Secret scan: pattern spans and sliding-window Shannon entropy, all in Spark SQL.

Pattern spans come first: assignments to secret-like names, access key ids and
long hex runs. The entropy method adds spans: each run of a character class is
a candidate, a window slides over it, and the window's entropy is kept by
incremental counts (one symbol enters, one leaves), so a run of n characters
costs n updates. Candidates that the allow-list knows are suppressed.

Everything is a narrow projection over ``text``: no shuffle, no Python. The
offsets of matches come from the lengths of the pieces that ``split`` leaves
between them, counted in code points, end exclusive.

Defined cases: a null text is an empty text and has no spans; null ids stay;
repeated rows give repeated results; other columns are passed by and never
looked up, so their names can't clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed patterns of the scan's contract. Letters of the names match in either
#: case (ASCII); group 1 is the value.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
#: A run from its first AKIA is the longest, so the length can stand in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

#: The order of kinds at equal starts.
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_b64")
BASE = KINDS[:3]

SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

#: Candidates that are no secrets: plain numbers, words joined by signs,
#: UUIDs, dates and times, runs of the alphabet, placeholders.
ALLOW = (
    r"^[0-9]+$",
    r"^[A-Za-z]+(?:[-_/=+][A-Za-z]+)*$",
    r"^[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[-_][0-9]{2}){0,3}$",
    r"^[-=_+/]+$",
    r"(?i)abcdefghij|0123456789|example|placeholder|your[-_]?(?:key|token|secret)",
)


@dataclass(frozen=True)
class CharClass:
    """A class of candidate strings: its pattern, window and least entropy in bits."""

    kind: str
    pattern: str
    window: int
    bits: float


CLASSES = (
    CharClass("entropy_hex", r"(?<![A-Za-z0-9+/_=-])[0-9a-fA-F]{20,}(?![A-Za-z0-9+/_=-])", 20, 3.0),
    CharClass("entropy_b64", r"[A-Za-z0-9+/_=-]{20,}", 20, 3.6),
)


def _between(text: Column, pattern: str) -> tuple[Column, Column]:
    """The matches of ``pattern`` and the pieces between them."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)


def _spans(text: Column, pattern: str, kind: str, value: Column | None = None) -> Column:
    """array<struct<s, k, e, kind, m, n>>: start, rank of the kind, end, kind, match, length of the value."""
    found, pieces = _between(text, pattern)
    n = F.lit(0) if value is None else None
    rank = KINDS.index(kind)
    zipped = F.arrays_zip(
        F.transform(pieces, F.length).alias("p"),
        found.alias("m"),
        (F.transform(found, lambda m: F.lit(0)) if n is not None else F.transform(value, F.length)).alias("n"),
    )
    # the last piece follows the last match and has none of its own
    rows = F.filter(zipped, lambda z: z["m"].isNotNull())
    one = "struct<s:int,k:int,e:int,kind:string,m:string,n:int>"
    walked = F.aggregate(
        rows,
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{one}>").alias("out")),
        lambda acc, z: F.struct(
            (acc["at"] + z["p"] + F.length(z["m"])).alias("at"),
            F.concat(
                acc["out"],
                F.array(
                    F.struct(
                        (acc["at"] + z["p"]).alias("s"),
                        F.lit(rank).alias("k"),
                        (acc["at"] + z["p"] + F.length(z["m"])).alias("e"),
                        F.lit(kind).alias("kind"),
                        z["m"].alias("m"),
                        z["n"].cast("int").alias("n"),
                    )
                ),
            ).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.when(text.rlike(pattern), walked).otherwise(F.array().cast(f"array<{one}>"))


def high_entropy(candidate: Column, window: int, bits: float) -> Column:
    """struct<first, last>: starts of the first and last window of at least ``bits``, -1 without one.

    With counts c of the window's symbols, H = log2 W - (sum c log2 c) / W; a
    step changes two counts and so two terms of the sum.
    """
    term = F.array(*[F.lit(float(c * math.log2(c)) if c else 0.0) for c in range(window + 2)])
    codes = F.transform(F.split(candidate, ""), lambda ch: F.instr(F.lit(SYMBOLS), ch))
    limit = float((math.log2(window) - bits) * window + 1e-9)

    def step(acc: Column, at: Column) -> Column:
        enters = acc["codes"][at]
        leaves = F.when(at >= window, acc["codes"][at - window]).otherwise(F.lit(0))
        same = enters == leaves
        up = acc["c"][enters]
        down = F.when(leaves > 0, acc["c"][leaves]).otherwise(F.lit(0))
        total = F.when(same, acc["sum"]).otherwise(
            acc["sum"]
            + term[up + 1]
            - term[up]
            + F.when(leaves > 0, term[down - 1] - term[down]).otherwise(F.lit(0.0))
        )
        counts = F.when(same, acc["c"]).otherwise(
            F.transform(
                acc["c"],
                lambda c, j: c + (j == enters).cast("int") - ((j == leaves) & (leaves > 0)).cast("int"),
            )
        )
        hit = (at >= window - 1) & (total <= limit)
        start = (at - window + 1).cast("int")
        return F.struct(
            acc["codes"].alias("codes"),
            counts.alias("c"),
            total.alias("sum"),
            F.when(hit & (acc["first"] < 0), start).otherwise(acc["first"]).alias("first"),
            F.when(hit, start).otherwise(acc["last"]).alias("last"),
        )

    return F.aggregate(
        F.sequence(F.lit(0), F.length(candidate) - 1),
        F.struct(
            codes.alias("codes"),
            F.array_repeat(F.lit(0), len(SYMBOLS) + 1).alias("c"),
            F.lit(0.0).alias("sum"),
            F.lit(-1).alias("first"),
            F.lit(-1).alias("last"),
        ),
        step,
        lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")),
    )


def _entropy_spans(text: Column, cls: CharClass, allow: tuple[str, ...]) -> Column:
    spans = _spans(text, cls.pattern, cls.kind)

    def wanted(x: Column) -> Column:
        keep = x["m"].rlike("[0-9]")
        for pattern in allow:
            keep = keep & ~x["m"].rlike(pattern)
        return keep

    scored = F.transform(
        F.filter(spans, wanted),
        lambda x: F.struct(x.alias("x"), high_entropy(x["m"], cls.window, cls.bits).alias("h")),
    )
    return F.transform(
        F.filter(scored, lambda y: y["h"]["first"] >= 0),
        lambda y: F.struct(
            (y["x"]["s"] + y["h"]["first"]).alias("s"),
            y["x"]["k"].alias("k"),
            (y["x"]["s"] + y["h"]["last"] + cls.window).alias("e"),
            y["x"]["kind"].alias("kind"),
        ),
    )


def find_secrets(
    docs: DataFrame,
    text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    classes: tuple[CharClass, ...] = CLASSES,
    allow: tuple[str, ...] = ALLOW,
) -> DataFrame:
    """``keep`` and ``secrets``: array<struct<s, k, e, kind>> ordered by start, then kind.

    An entropy span runs from the first to the last window of high entropy of
    its candidate; where a hex and a mixed candidate are the same string, only
    the hex one counts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = F.concat(
        F.filter(
            _spans(text, ASSIGN, "assign", F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(1))),
            lambda x: x["n"] >= ASSIGN_LEAST,
        ),
        _spans(text, ACCESS, "access"),
        _spans(text, HEX, "hex"),
    )
    plain = F.transform(
        base,
        lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["kind"].alias("kind")),
    )
    mixed_only = r"^[0-9a-fA-F]+$"
    parts = [plain]
    for cls in classes:
        own = allow if cls.kind == "entropy_hex" else (*allow, mixed_only)
        parts.append(_entropy_spans(text, cls, own))
    return docs.select(*keep, F.array_sort(F.concat(*parts)).alias("secrets"))


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined in the order of the array."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")

    base = F.filter("secrets", lambda x: x["kind"].isin(*BASE))
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("secrets")).alias("spans"),
    )
