"""URL filter: an Aho-Corasick automaton over a weighted vocabulary, and host/path rules that go before it.

Strict terms reject alone; soft terms reject when enough different ones occur. A term counts only where no
ASCII letter or digit touches it, so ``win`` is found in ``casino-win.example`` but not in ``window``.

Defined cases: a null URL, or one without ``://``, has an empty host and path and fits no rule; a null URL has no terms
(allowed). Repeated rows and terms are judged alike; a term that occurs twice counts once. Extra columns stay as they are
unless they have a name of a result column, which then is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

#: The vocabulary and its weights. A term of weight 1 or more is strict.
TERMS = {
    "casino": 1.0, "escort": 1.0, "malware": 1.0, "phishing": 1.0, "porn": 1.0, "spam": 1.0, "viagra": 1.0, "warez": 1.0, "xxx": 1.0,
    "ads": 0.5, "affiliate": 0.5, "banner": 0.5, "bet": 0.5, "bonus": 0.5, "cheap": 0.5, "click": 0.5, "farm": 0.5, "free": 0.5,
    "loan": 0.5, "lottery": 0.5, "pills": 0.5, "prize": 0.5, "promo": 0.5, "track": 0.5, "win": 0.5,
}
SOFT_HITS = 2
#: Fixed values of the contract: (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@lru_cache(maxsize=8)
def _automaton(terms: tuple[str, ...]):
    import ahocorasick

    made = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        made.add_word(term, (i, len(term)))
    made.make_automaton()
    return made


def _edge(text: str, i: int) -> bool:
    return not (0 <= i < len(text) and text[i].isascii() and text[i].isalnum())


def hits(text: str, terms: tuple[str, ...]) -> set[int]:
    """Which terms occur with nothing alphanumeric beside them."""
    if not terms:
        return set()
    return {i for end, (i, n) in _automaton(terms).iter(text) if _edge(text, end + 1) and _edge(text, end - n)}


def host_and_path(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (ASCII lower case) and path; both empty for null and for URLs without ``://``."""
    rest = F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://(.*)$", 1), F.lit(""))
    return df.withColumns({
        "host": F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER),
        "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1),
    })


def rule_columns(rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, what in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def filter_urls(pages: DataFrame, url: str = "url", terms: Mapping[str, float] = TERMS, soft_hits: int = SOFT_HITS, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """Adds host, path, rule, verdict (allow or block), terms (those found, sorted), n_strict, n_soft and weight (the found terms' sum)."""
    words = tuple(sorted(terms))
    weights = [float(terms[w]) for w in words]

    @F.pandas_udf("terms array<string>, n_strict int, n_soft int, weight double")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for urls in batches:
            rows = [sorted(hits(x, words)) if isinstance(x, str) else [] for x in urls]
            yield pd.DataFrame({
                "terms": [[words[i] for i in r] for r in rows],
                "n_strict": [sum(weights[i] >= 1 for i in r) for r in rows],
                "n_soft": [sum(weights[i] < 1 for i in r) for r in rows],
                "weight": [float(sum(weights[i] for i in r)) for r in rows],
            })

    rule, verdict = rule_columns(rules)
    own = F.when((F.col("_hits.n_strict") > 0) | (F.col("_hits.n_soft") >= soft_hits), "block").otherwise("allow")
    return (
        host_and_path(pages, url)
        .withColumn("_hits", found(F.translate(F.col(url), UPPER, LOWER)))
        .withColumns({"rule": rule, "verdict": F.coalesce(verdict, own), **{c: F.col(f"_hits.{c}") for c in ("terms", "n_strict", "n_soft", "weight")}})
        .drop("_hits")
    )


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", F.array_join("terms", ",").alias("terms"), "n_strict", "n_soft", "weight")


def _sql() -> str:
    low = f"translate(coalesce(url, ''), '{UPPER}', '{LOWER}')"
    found = {w: f"regexp_matches(low, '(^|[^a-z0-9]){w}([^a-z0-9]|$)')" for w in sorted(TERMS)}
    count = lambda strict: " + ".join(f"CAST({found[w]} AS INTEGER)" for w in found if (TERMS[w] >= 1) == strict)
    fits = lambda h, p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')"
    ordered = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in ordered) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in ordered) + f" WHEN n_strict > 0 OR n_soft >= {SOFT_HITS} THEN 'block' ELSE 'allow' END"
    terms = "concat_ws(',', " + ", ".join(f"CASE WHEN {found[w]} THEN '{w}' END" for w in found) + ")"
    return f"""
WITH a AS (
  SELECT page_id, {low} AS low,
         CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), b AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a
), c AS (
  SELECT page_id, host, path, {terms} AS terms, {count(True)} AS n_strict, {count(False)} AS n_soft FROM b
)
SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict, terms, n_strict, n_soft,
       CAST(n_strict * 1.0 + n_soft * 0.5 AS DOUBLE) AS weight
FROM c"""


OP1_SQL = _sql()
