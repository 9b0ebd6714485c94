"""URL filters: allow and block rules by host and path, then a weighted vocabulary.

Rules decide first: a rule (host, path) fits its host and all subdomains if the url's
path starts with the rule's; the longest fitting rule wins. Otherwise one Aho-Corasick
pass over the lower-cased (A-Z) url counts vocabulary terms that stand free, that is
with no ASCII letter or digit on either side. One strict term, or SOFT_HITS different
soft terms, block the url.

A NULL url or one without ``://`` has an empty host and path; the vocabulary still
judges what text there is, and NULL is allowed. Repeated rows get equal verdicts. Only
the url column is read; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterweave.llm.columns import unused

# Default vocabulary: a parameter, kept short.
STRICT = ("spam-farm", "casino", "porn", "viagra", "xxx")
SOFT = ("adult", "bet", "bonus", "cheap", "deal", "farm", "free", "loan", "pills", "sale", "spam", "win")
SOFT_HITS = 2
#: Rules of the registered query: (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Characters of terms that are broadcast at most.
MAX_VOCABULARY = 4 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule as text, its verdict), both NULL if none fits."""
    longest = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))

    def fits(h, p):
        return ((host == h) | host.endswith(f".{h}")) & path.startswith(p)

    if not longest:
        return F.lit(None).cast("string"), F.lit(None).cast("string")
    return tuple(
        F.coalesce(*[F.when(fits(h, p), F.lit(value(h, p, v))) for h, p, v in longest])
        for value in (lambda h, p, v: h + p, lambda h, p, v: v)
    )


def vocabulary_hits(docs: DataFrame, strict: Sequence[str], soft: Sequence[str], url: str = "url", out: str = "hits") -> DataFrame:
    """Add struct ``out``: number of different strict and soft terms in the url."""
    if sum(map(len, (*strict, *soft))) > MAX_VOCABULARY:
        raise ValueError(f"the vocabulary has more than {MAX_VOCABULARY} characters")
    terms = docs.sparkSession.sparkContext.broadcast((tuple(strict), tuple(soft)))

    @F.arrow_udf("struct<strict:int,soft:int>")
    def counted(url: pa.Array) -> pa.Array:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        kinds: dict[str, int] = {}
        for kind, words in enumerate(terms.value):
            for word in words:
                kinds[word] = kinds.get(word, 0) | (1 << kind)
        for word, kind in kinds.items():
            if word:
                automaton.add_word(word, (word, kind))
        automaton.make_automaton()
        table = str.maketrans(_UPPER, _LOWER)
        columns = ([], [])
        for x in url.to_pylist():
            text, found = (x or "").translate(table), {}
            if len(automaton) and text:
                for last, (word, kind) in automaton.iter(text):
                    first = last - len(word)
                    if (first < 0 or text[first] not in _WORD) and (last + 1 == len(text) or text[last + 1] not in _WORD):
                        found[word] = kind
            for kind, column in enumerate(columns):
                column.append(sum(k >> kind & 1 for k in found.values()))
        return pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in columns], ["strict", "soft"])

    return docs.withColumn(out, counted.asNondeterministic()(F.col(url).cast("string")))


def judge(
    pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, strict: Sequence[str] = STRICT,
    soft: Sequence[str] = SOFT, soft_hits: int = SOFT_HITS, url: str = "url", out: str = "judged",
) -> DataFrame:
    """Add struct ``out``: host, path, rule, strict and soft hits, verdict (allow or block)."""
    names = [unused(pages, x) for x in ("_hits", "_host", "_path")]
    hits, h, p = map(F.col, names)
    found = vocabulary_hits(pages, strict, soft, url, names[0])
    named = found.withColumn(names[1], host(F.col(url))).withColumn(names[2], path(F.col(url)))
    text, verdict = rule(h, p, rules)
    bad = (hits["strict"] > 0) | (hits["soft"] >= soft_hits)
    return named.withColumn(
        out,
        F.struct(
            h.alias("host"), p.alias("path"), text.alias("rule"),
            hits["strict"].alias("strict"), hits["soft"].alias("soft"),
            F.coalesce(verdict, F.when(bad, "block").otherwise("allow")).alias("verdict"),
        ),
    ).drop(*names)


def digest(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule and verdict of each page."""
    return judge(pages.select("page_id", "url")).select(
        "page_id", "judged.host", "judged.path", "judged.rule", "judged.verdict"
    )
