"""Text normal forms and token similarity as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers' regular expressions define it; Java's \s is narrower.
WS = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
#: Pattern text that begins, or ends, with a word character whatever it matches.
_WORD_NEXT = re.compile(r"\\d(?![*?])|[A-Za-z0-9_](?![*?{|])|\[0-9a-f\]\{|\(\?=\[0-9a-f\]|\((?:(?:\\d\+|[a-z]+(?:[a-z]\?)?)\|?)+\)(?![*?])")
_WORD_BEFORE = re.compile(r"(?:(?<![\\])[A-Za-z0-9_]|(?:\\d|\[0-9a-f\])\{\d+,?\d*\})$")
_BOUNDARY = r"(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"


def let(c: Column, f: Callable[[Column], Column]) -> Column:
    """f(c) with c evaluated once, however often f uses it: a lambda's variable, where a column would be repeated."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def collapse_ws(c: Column) -> Column:
    """Runs of white space as one space; zero-width characters go."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\u200B-\u200D\uFEFF]", ""), f"[{WS}]+", " "))


def unify_typography(c: Column) -> Column:
    """Curly quotes, long dashes and the ellipsis as their plain forms."""
    return F.replace(F.translate(c, "\u2018\u2019\u201A\u2032\u201C\u201D\u201E\u2033\u2013\u2014\u2212", "''''\"\"\"\"---"), F.lit("\u2026"), F.lit("..."))


def java_regex(pattern: str, flags: str = "") -> str:
    """A browser-style pattern for Java: ASCII word boundaries; the i flag.

    A boundary beside what must be a word character needs one look only, which is much faster than the
    general form.
    """
    out, at = [], 0
    for m in re.finditer(r"\\\\|\\b", pattern):
        out.append(pattern[at : m.start()])
        at = m.end()
        if m[0] != r"\b":
            out.append(m[0])
        elif _WORD_NEXT.match(pattern, at):
            out.append("(?<![0-9A-Za-z_])")
        elif _WORD_BEFORE.search(pattern[: m.start()]):
            out.append("(?![0-9A-Za-z_])")
        else:
            out.append(_BOUNDARY)
    return ("(?i)" if "i" in flags else "") + "".join(out) + pattern[at:]


def _mask(c: Column, patterns: list[dict]) -> Column:
    for p in patterns:
        name = "{" + p["name"] + "}"
        c = F.regexp_replace(c, java_regex(p["pattern"], p.get("flags") or ""), re.sub(r"([$\\])", r"\\\1", name))
    return c


def norm_of_raw(raw: Column, cfg: dict) -> Column:
    """Norm form of text whose white space is collapsed."""
    return _mask(unify_typography(raw), [p for p in cfg["ignore"]["allTextPatterns"] if p.get("mode") != "cosmetic"])


def norm_text(c: Column, cfg: dict) -> Column:
    """Decides whether two values differ at all: `ignore` patterns are masked."""
    return norm_of_raw(collapse_ws(c), cfg)


def cosmetic_text(norm: Column, cfg: dict) -> Column:
    """From the norm form: `cosmetic` patterns masked too, no case, no punctuation."""
    t = _mask(norm, [p for p in cfg["ignore"]["allTextPatterns"] if p.get("mode") == "cosmetic"])
    if not cfg["ignore"]["caseAndPunctuationIsCosmetic"]:
        return t
    t = F.regexp_replace(F.lower(t), r"(?<=\{[a-z-]{0,99})-(?=[a-z-]*\})", "_")
    t = F.regexp_replace(t, rf"[^\p{{L}}\p{{N}}{{}}_{WS}]", "")
    return F.trim(F.regexp_replace(t, f"[{WS}]+", " "))


def value(c: Column, cfg: dict) -> Column:
    """The three forms of a compared value."""
    norm = norm_text(c, cfg)
    return F.struct(collapse_ws(c).alias("raw"), norm.alias("norm"), cosmetic_text(norm, cfg).alias("cos"))


def with_values(items: Column, field: str, rest: dict, cfg: dict) -> Column:
    """An array of structs with `field` as its three forms and `rest` (name to function of the item).

    The forms are made in steps, so that none is computed twice.
    """
    others = lambda x: [x[n].alias(n) for n in rest]
    s1 = F.transform(items, lambda x: F.struct(collapse_ws(x[field]).alias("raw"), *(f(x).alias(n) for n, f in rest.items())))
    s2 = F.transform(s1, lambda x: F.struct(x["raw"].alias("raw"), norm_of_raw(x["raw"], cfg).alias("norm"), *others(x)))
    return F.transform(s2, lambda x: F.struct(F.struct(x["raw"].alias("raw"), x["norm"].alias("norm"), cosmetic_text(x["norm"], cfg).alias("cos")).alias("text"), *others(x)))


def tokens(c: Column) -> Column:
    found = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}$€£%.,]+"), F.lit(0))
    return F.filter(F.transform(found, lambda w: F.regexp_replace(w, "[.,]+$", "")), lambda w: w != "")


def dice(a: Column, b: Column) -> Column:
    """Word-multiset Dice coefficient; equal strings are 1, a side without tokens is 0."""
    count = lambda ts, w: F.size(F.filter(ts, lambda x: x == w))

    def of(t: Column) -> Column:
        shared = F.aggregate(F.array_intersect(t["a"], t["b"]), F.lit(0), lambda acc, w: acc + F.least(count(t["a"], w), count(t["b"], w)))
        return F.when((F.size(t["a"]) == 0) | (F.size(t["b"]) == 0), F.lit(0.0)).otherwise(shared * 2.0 / (F.size(t["a"]) + F.size(t["b"])))

    return F.when(a == b, F.lit(1.0)).otherwise(let(F.struct(tokens(a).alias("a"), tokens(b).alias("b")), of))


#: Words of a page that count for its shingles.
SHINGLE_WORDS = 4000


def _words(c: Column, most: int) -> Column:
    return F.slice(F.filter(F.split(F.lower(c), f"[{WS}]+"), lambda x: x != ""), 1, most)


def shingles(c: Column, n: int = 3, most: int = SHINGLE_WORDS) -> Column:
    """Distinct n-word shingles of the first `most` words; fewer words make one shingle."""

    def of(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(1), F.size(w) - (n - 1)), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
        return F.when(F.size(w) == 0, F.array().cast("array<string>")).when(F.size(w) < n, F.array(F.array_join(w, " "))).otherwise(F.array_distinct(many))

    return let(_words(c, most), of)


def shingle_hashes(c: Column, n: int = 3, most: int = SHINGLE_WORDS) -> Column:
    """The shingles as 64-bit hashes, made without their texts."""

    def of(w: Column) -> Column:
        many = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(n))))
        return F.when(F.size(w) == 0, F.array().cast("array<bigint>")).when(F.size(w) < n, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(F.array_distinct(many))

    return let(_words(c, most), of)


def jaccard(a: Column, b: Column) -> Column:
    inter = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(inter / (F.size(a) + F.size(b) - inter))
