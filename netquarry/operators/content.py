"""Content detectors and entity extraction over text columns: regular expressions of the JVM, one pass, no shuffle but for distinct.

Defined cases: null texts have nothing; repeated rows each count; texts of any length are read whole; other columns are not read. No rows: no result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The detectors' patterns.
PATTERNS = {
    "sqli": (r"(?i)\bOR\b\s+['\"]?\d['\"]?\s*=\s*['\"]?\d", r"(?i)DROP\s+TABLE", r"(?i)UNION\s+SELECT"),
    "xss": (r"(?i)<script>", r"(?i)onerror=", r"(?i)javascript:"),
    "commands": (r"(?i)powershell.*-EncodedCommand", r"(?i)powershell.*-ExecutionPolicy Bypass", r"(?i)whoami", r"(?i)curl.*\|.*bash", r"(?i)wget.*-O"),
    "dns_tunneling": (r"([A-Za-z0-9_-]{30,})\.[a-zA-Z0-9-]+\.[a-zA-Z]{2,}",),
    "malware_hash": (r"[A-Fa-f0-9]{32,64}",),
    "lateral_movement": (r"(?i)PSEXESVC", r"(?i)IPC\$"),
    "backup": (r"(?i)backup_agent\.exe",),
}
#: The patterns of entities.
ENTITIES = {
    "ip": r"\b((?:[0-9]{1,3}\.){3}[0-9]{1,3})\b",
    "hash": r"\b([A-Fa-f0-9]{32,64})\b",
    "domain": r"\b([a-zA-Z0-9.-]+\.[a-zA-Z]{2,})\b",
    "process": r"\b([a-zA-Z0-9_]+\.exe)\b",
    "port": r"(?:port |:)(\d{2,5})\b",
    "endpoint": r" (/[a-zA-Z0-9_/?=-]*) HTTP",
}


def detector(name: str, text: Column) -> Column:
    """Whether the detector fires on the text; null texts never do."""
    found = F.lit(False)
    for p in PATTERNS[name]:
        found = found | text.rlike(p)
    if name == "dns_tunneling":
        found = found & ~text.contains("dns.google")
    if name == "malware_hash":
        found = found & F.lower(text).contains("family:")
    return F.coalesce(found, F.lit(False))


def detect(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and one boolean column for each detector, for the rows on which any of them fires."""
    out = df.select(key, *[detector(n, F.col(text)).alias(n) for n in PATTERNS])
    fired = F.lit(False)
    for n in PATTERNS:
        fired = fired | F.col(n)
    return out.where(fired)


def entities(df: DataFrame, text: str) -> DataFrame:
    """(kind, value, n_rows): the distinct entities, and in how many rows each occurs. Pre-aggregated before the shuffle."""
    def found_of(kind: str) -> Column:
        return F.transform(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(ENTITIES[kind]), 1)), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("value")))

    found = [found_of(kind) for kind in ENTITIES]
    return df.where(F.col(text).isNotNull()).select(F.explode(F.concat(*found)).alias("e")).groupBy("e.kind", "e.value").agg(F.count("*").alias("n_rows"))


def detect_sql(source: str, key: str, text: str) -> str:
    def one(name: str) -> str:
        sql = " OR ".join(f"regexp_matches({text}, '{p.replace(chr(39), chr(39) * 2)}')" for p in PATTERNS[name])
        extra = {"dns_tunneling": f" AND NOT contains({text}, 'dns.google')", "malware_hash": f" AND contains(lower({text}), 'family:')"}.get(name, "")
        return f"coalesce(({sql}){extra}, false) AS {name}"

    return f"SELECT * FROM (SELECT {key}, {', '.join(map(one, PATTERNS))} FROM {source}) WHERE {' OR '.join(PATTERNS)}"


def entities_sql(source: str, text: str) -> str:
    each = " UNION ALL ".join(f"SELECT '{k}' AS kind, unnest(list_distinct(regexp_extract_all({text}, '{p}', 1))) AS value FROM {source}" for k, p in ENTITIES.items())
    return f"SELECT kind, value, count(*) AS n_rows FROM ({each}) GROUP BY ALL"
