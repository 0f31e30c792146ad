"""Derived columns of canonical events, as SQL expressions in layers: each layer uses the columns of those before it.

The expressions are built-in functions only, so Catalyst keeps them in generated code, prunes the unused ones and pushes filters
below them. ``{matches}`` stands for the engine's regular-expression predicate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words, ports and services of the rules.
BLOCKED = ("block", "blocked", "deny", "denied", "drop", "dropped", "reject", "rejected")
BLOCKED_LEGACY = ("block", "deny", "drop")
ALLOWED = ("allow", "allowed", "accept", "accepted", "pass", "passed")
SERVICES = {
    "database": (1433, 1521, 3306, 5432), "docker": (2375, 2376), "elasticsearch": (9200,), "ftp": (21,), "ftp_data": (20,), "ipmi": (623,),
    "kubernetes": (6443, 10250), "ldap": (389,), "memcached": (11211,), "mongodb": (27017,), "msrpc": (135,), "rdp": (3389,), "redis": (6379,),
    "smb": (139, 445), "snmp": (161,), "ssh": (22, 2022, 2222), "telnet": (23,), "vnc": (5900, 5901, 5902, 5903, 5904, 5905), "winrm": (5985, 5986),
}
SENSITIVE_PORTS = (20, 21, 22, 23, 135, 139, 389, 445, 1433, 3306, 3389, 5432, 5900)
CRITICAL_PORTS = (161, 623, 2375, 5985, 6379, 9200, 10250, 11211, 27017)
ADMIN_PORTS = (8000, 8080, 8443, 8888, 9000, 9443, 10000)
#: Words of zone names.
WAN_WORDS, LAN_WORDS = "wan|wan[0-9]+|internet|external|outside|untrust", "lan|internal|inside|trust"
#: Special IPv4 blocks (IANA). Documentation, benchmarking and reserved space are private, shared space is neither.
PRIVATE_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/29", "192.0.0.170/31", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4",
)
SHARED_V4 = ("100.64.0.0/10",)
#: Special IPv6 blocks (IANA) by the beginnings of their addresses in lower case: unusable (loopback, unspecified, link-local, multicast),
#: exceptions that are public, and private ones.
_ZERO = "0{1,4}"
UNUSABLE_V6 = (f"({_ZERO}:|:)*:?({_ZERO}|0{{0,3}}1)?", "fe[89ab][0-9a-f]:.*", "ff[0-9a-f]{2}:.*")
PUBLIC_V6 = ("2001:0{0,3}3:.*", "2001:0{0,2}[23][0-9a-f]:.*", "2001:0{0,3}4:0?112:.*", f"2001:0{{0,3}}1:(:|({_ZERO}:)+:?|:({_ZERO}:)*)0{{0,3}}[12]")
PRIVATE_V6 = (
    "f[cd][0-9a-f]{2}:.*", "2001:0?db8:.*", "2001::.*", "2001:(0{0,2}[0-9a-f]{1,2}|0?[01][0-9a-f]{2}):.*", "2002:.*", f"0?100:(:|({_ZERO}:){{3}}).*", "0{0,2}64:ff9b:0{0,3}1:.*",
)
UNUSABLE_V4 = ("127.0.0.0/8", "224.0.0.0/4", "0.0.0.0/32", "169.254.0.0/16")  # loopback, multicast, unspecified, link-local


def _words(values) -> str:
    return "(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in values) + ")"


def _ranges(blocks) -> list[tuple[int, int]]:
    out = []
    for b in blocks:
        address, _, bits = b.partition("/")
        low = sum(int(x) << s for x, s in zip(address.split("."), (24, 16, 8, 0), strict=True))
        out.append((low, low + (1 << 32 - int(bits)) - 1))
    return out


def _class(number: str) -> str:
    """Of an address number: 'unusable', 'private', 'shared' or 'public'; null of null."""
    blocks = (("unusable", UNUSABLE_V4), ("private", PRIVATE_V4), ("shared", SHARED_V4))
    within = lambda b: " OR ".join(f"{number} BETWEEN {lo} AND {hi}" for lo, hi in _ranges(b))
    return f"CASE WHEN {number} IS NULL THEN NULL {' '.join(f'WHEN {within(b)} THEN {chr(39)}{name}{chr(39)}' for name, b in blocks)} ELSE 'public' END"


def _v4(ip: str) -> str:
    """The address as a number; null if it is no dotted IPv4 address."""
    part = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
    value = " + ".join(f"CAST(split_part({ip}, '.', {i}) AS BIGINT) * {1 << 32 - 8 * i}" for i in (1, 2, 3, 4))
    return f"CASE WHEN {{matches}}({ip}, '^{part}[.]{part}[.]{part}[.]{part}$') THEN {value} END"


def _valid_v6(ip: str) -> str:
    """Whether text is an IPv6 address of hexadecimal groups (without a dotted tail or a zone)."""
    groups, colons = "[0-9a-fA-F]{1,4}(:[0-9a-fA-F]{1,4})*", f"(length({ip}) - length(replace({ip}, ':', '')))"
    short = f"{{matches}}({ip}, '^({groups})?::({groups})?$') AND {colons} <= CASE WHEN {ip} LIKE '::%' OR {ip} LIKE '%::' THEN 8 ELSE 7 END"
    return f"({ip} LIKE '%:%' AND length({ip}) <= 39 AND (({short}) OR ({{matches}}({ip}, '^{groups}$') AND {colons} = 7)))"


def subnet_sql(ip: str, v4: str) -> str:
    """The /24 of an IPv4 address (v4 is not null) or the /64 of an IPv6 one, in SQL that Spark and DuckDB share; null of other text."""
    left, right = f"split_part(lower({ip}), '::', 1)", f"split_part(lower({ip}), '::', 2)"
    groups = lambda x: f"(CASE WHEN {x} = '' THEN 0 ELSE length({x}) - length(replace({x}, ':', '')) + 1 END)"
    full = f"(CASE WHEN {ip} LIKE '%::%' THEN {left} || CASE WHEN {left} = '' THEN '' ELSE ':' END || repeat('0:', 8 - {groups(left)} - {groups(right)}) || {right} ELSE lower({ip}) END)"
    four = " || ':' || ".join(f"coalesce(nullif(regexp_replace(split_part({full}, ':', {i}), '^0+', ''), ''), '0')" for i in range(1, 5))
    v6 = f"regexp_replace(regexp_replace({four}, '(:0)+$', ''), '^0$', '') || '::/64'"
    v4_net = " || '.' || ".join(f"split_part({ip}, '.', {i})" for i in range(1, 4)) + " || '.0/24'"
    return f"CASE WHEN {v4} IS NOT NULL THEN {v4_net} WHEN {ip} LIKE '%:%' THEN {v6} END"


def _class_of(number: str, ip: str) -> str:
    """The class of an address of either kind; null of other text."""
    begins = lambda blocks: " OR ".join(f"{{matches}}(lower({ip}), '^{b}$')" for b in blocks)
    return f"CASE WHEN {number} IS NOT NULL THEN {_class(number)} WHEN coalesce({_valid_v6(ip)}, false) THEN CASE WHEN {begins(UNUSABLE_V6)} THEN 'unusable' WHEN {begins(PUBLIC_V6)} THEN 'public' WHEN {begins(PRIVATE_V6)} THEN 'private' ELSE 'public' END END"


def _service(port: str) -> str:
    return f"CASE {' '.join(f'WHEN {port} IN {_words(ports)} THEN {chr(39)}{name}{chr(39)}' for name, ports in SERVICES.items())} END"


def _zone(zone: str, tokens: str) -> str:
    return f"coalesce({{matches}}(lower(substr({zone}, 1, 128)), '(^|[-_ \\t\\n\\r])({tokens})($|[-_ \\t\\n\\r])'), false)"


def _flag(name: str) -> str:
    return f"(coalesce(',' || tcp_flags || ',', '') LIKE '%,{name},%')"


def _usable(kind: str) -> str:
    return f"coalesce({kind} <> 'unusable', false)"


def _private(kind: str) -> str:
    return f"coalesce({kind} = 'private', false)"


def _public(kind: str) -> str:
    return f"coalesce({kind} = 'public', false)"


#: Layers whose columns are long expressions that later ones name often: each row's are computed once (see with_features).
FIRM = (0, 1)

LAYERS: tuple[dict[str, str], ...] = (
    {"src_v4": _v4("src_ip"), "dst_v4": _v4("dst_ip"), "trans_v4": _v4("translated_dst_ip")},
    {
        "src_class": _class_of("src_v4", "src_ip"), "dst_class": _class_of("dst_v4", "dst_ip"), "trans_class": _class_of("trans_v4", "translated_dst_ip"),
        "net24": f"CASE WHEN dst_v4 IS NOT NULL OR coalesce({_valid_v6('dst_ip')}, false) THEN {subnet_sql('dst_ip', 'dst_v4')} END",  # of IPv6 the /64
    },
    {
        "blocked": f"coalesce(lower(trim(action)) IN {_words(BLOCKED)}, false)",
        "blocked_legacy": f"coalesce(lower(action) IN {_words(BLOCKED_LEGACY)}, false)",
        "allowed": f"coalesce(lower(trim(action)) IN {_words(ALLOWED)}, false)",
        "proto_raw": "CASE WHEN coalesce(protocol, '') = '' THEN 'UNKNOWN' ELSE protocol END",
        "proto": "CASE WHEN coalesce(protocol, '') = '' THEN 'UNKNOWN' ELSE upper(protocol) END",
        "service": _service("dst_port"),
        "eff_dst": "CASE WHEN coalesce(trim(translated_dst_ip), '') <> '' THEN translated_dst_ip ELSE dst_ip END",
        "eff_port": "coalesce(translated_dst_port, dst_port)",
        "wan_in": _zone("inbound_zone", WAN_WORDS),
        "lan_out": _zone("outbound_zone", LAN_WORDS),
        "dmz_out": _zone("outbound_zone", "dmz"),
        "wan_out": _zone("outbound_zone", WAN_WORDS), "lan_in": _zone("inbound_zone", LAN_WORDS), "dmz_in": _zone("inbound_zone", "dmz"),
        "has_syn": _flag("SYN"), "has_ack": _flag("ACK"), "has_rst": _flag("RST"), "has_fin": _flag("FIN"),
    },
    {
        "tcp": "proto = 'TCP'",
        "syn": "proto = 'TCP' AND has_syn AND NOT has_ack",
        "probe": "proto = 'TCP' AND has_syn AND NOT has_ack AND NOT has_rst AND NOT has_fin",
        "spi": "coalesce(lower(action_reason) LIKE '%spi%', false) OR coalesce(lower(event_outcome) LIKE '%spi%', false) OR coalesce(lower(action) LIKE '%spi%', false) OR coalesce(lower(safe_message_excerpt) LIKE '%blocked by spi%', false)",
        "eff_service": _service("eff_port"),
        "eff_class": "CASE WHEN coalesce(trim(translated_dst_ip), '') <> '' THEN trans_class ELSE dst_class END",
        "ips_valid": "src_class IS NOT NULL AND dst_class IS NOT NULL",
        "src_usable": _usable("src_class"), "src_public": _public("src_class"), "src_private": _private("src_class"), "dst_private": _private("dst_class"),
        "dst_public": _public("dst_class"), "trans_private": _private("trans_class"),
    },
    {
        "spi_block": "spi AND (blocked OR coalesce(lower(action) LIKE '%block%' OR lower(action) LIKE '%deny%' OR lower(action) LIKE '%drop%', false) OR coalesce(lower(safe_message_excerpt) LIKE '%blocked by spi%', false))",
        "eff_usable": _usable("eff_class"), "eff_private": _private("eff_class"),
        "service_or_port": "coalesce(eff_service, CASE WHEN eff_port BETWEEN 1 AND 65535 THEN 'tcp_' || CAST(eff_port AS {string}) END)",
        "sensitive_service": f"CASE WHEN eff_port IN {_words((*SENSITIVE_PORTS, *CRITICAL_PORTS))} THEN eff_service END",
        "critical_port": f"coalesce(eff_port IN {_words(CRITICAL_PORTS)}, false)",
    },
    {
        "flow": "CASE WHEN wan_in AND (lan_out OR dmz_out) THEN 'inbound' WHEN wan_out AND (lan_in OR dmz_in) THEN 'outbound' WHEN wan_in THEN 'inbound' WHEN wan_out THEN 'outbound' WHEN src_class IS NULL OR eff_class IS NULL THEN 'unknown' WHEN src_private AND eff_private THEN 'lateral' WHEN eff_private THEN 'inbound' WHEN src_private THEN 'outbound' ELSE 'unknown' END",
        "admin_service": f"coalesce(sensitive_service, CASE WHEN eff_port IN {_words(ADMIN_PORTS)} THEN 'web_admin' END)",
        "inside": "src_private AND eff_private",
        "external": "NOT (src_private AND eff_private) AND (wan_in OR (src_public AND eff_private) OR (dst_public AND trans_private))",
        "exposable": "src_usable AND eff_usable AND eff_port IS NOT NULL AND proto = 'TCP'",
        "direction": "CASE WHEN src_private AND eff_private THEN 'private_internal' WHEN wan_in AND lan_out THEN 'wan_to_lan' WHEN wan_in AND dmz_out THEN 'wan_to_dmz' WHEN wan_in THEN 'external_inbound' WHEN dst_public AND trans_private THEN 'dnat_inbound' WHEN src_public AND eff_private THEN 'public_to_private' ELSE 'unknown' END",
    },
)


def with_features(events: DataFrame) -> DataFrame:
    """Adds all derived columns. Null actions, ports, addresses and zones give false (or null services), never null flags.
    IPv6 addresses have classes as IPv4 ones have (an IPv4 address within an IPv6 one counts as public), but no number; their net24 is the /64.

    Columns of FIRM layers are made by a generator of one row, which the optimizer does not copy into every expression that names them."""
    for i, layer in enumerate(LAYERS):
        made = {name: F.expr(sql.replace("{matches}", "regexp_like").replace("{string}", "STRING").replace("\\", "\\\\")) for name, sql in layer.items()}
        if i in FIRM:
            events = events.select("*", F.inline(F.array(F.struct(*[x.alias(name) for name, x in made.items()]))))
        else:
            events = events.withColumns(made)
    return events


def features_sql(source: str) -> str:
    """The same layers around a table expression, for DuckDB."""
    for layer in LAYERS:
        columns = ", ".join(f"{sql.replace('{matches}', 'regexp_matches').replace('{string}', 'VARCHAR')} AS {name}" for name, sql in layer.items())
        source = f"(SELECT *, {columns} FROM {source})"
    return source
