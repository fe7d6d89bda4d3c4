"""Column functions that find and classify URLs and addresses."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from sieveline import refdata as R

HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/:?#]*)"


def urls_in(text: Column) -> Column:
    """All URLs of a text in order, without trailing punctuation."""
    found = F.when(F.contains(text, F.lit("://")), F.regexp_extract_all(text, F.lit(R.URL), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:)\]}'\"]+$", ""))


def ip_ports_in(text: Column) -> Column:
    return F.when(F.contains(text, F.lit(":")), F.regexp_extract_all(text, F.lit(R.IP_PORT), F.lit(0))).otherwise(F.array().cast("array<string>"))


def host_of(url: Column) -> Column:
    """Host in lower case without brackets and the last dot; empty if there is none."""
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(F.lower(url), HOST, 1), r"[\[\]]", ""), r"\.+$", "")


def suffixes(host: Column) -> Column:
    """The host and every domain that it lies in: a.b.c, b.c, c."""
    parts = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))


def within(host: Column, domains: list[str]) -> Column:
    return F.arrays_overlap(suffixes(host), F.array(*map(F.lit, domains)))


def ipv4_number(text: Column) -> Column:
    """An IPv4 address as a number; null where it is none (octets over 255 or with leading zeros)."""
    octet = "(0|[1-9][0-9]{0,2})"
    parts = F.split(F.when(text.rlike(rf"^{octet}\.{octet}\.{octet}\.{octet}$"), text), r"\.")
    n = F.transform(parts, lambda p: p.cast("long"))
    return F.when(F.array_max(n) <= 255, n[0] * 16777216 + n[1] * 65536 + n[2] * 256 + n[3])


def _number(text: str) -> int:
    a, b, c, d = map(int, text.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def is_private_ipv4(number: Column) -> Column:
    out = F.lit(False)
    for first, last in R.PRIVATE_IPV4:
        out = out | number.between(_number(first), _number(last))
    return out


#: What the domain of a URL says, first matching list first: (domains, severity, confidence, label).
DOMAIN_LISTS = [
    (R.PASTE_DOMAINS, R.REVIEW, R.MEDIUM, "paste site"), (R.TUNNEL_DOMAINS, R.REVIEW, R.MEDIUM, "tunnel or dynamic DNS"), (R.FILE_HOST_DOMAINS, R.REVIEW, R.MEDIUM, "anonymous file host"),
    (R.IP_LOOKUP_DOMAINS, R.REVIEW, R.MEDIUM, "public IP lookup"), (R.SHORTENER_DOMAINS, R.REVIEW, R.LOW, "URL shortener"), (R.FREE_TLDS, R.REVIEW, R.LOW, "free top-level domain"),
    (R.KNOWN_DOMAINS, R.INFO, R.HIGH, "well-known domain"),
]


def domain_place(host: Column) -> Column:
    """The least place in DOMAIN_LISTS of a domain that the host lies in, or null; the host's domains are looked up in one table."""
    places = {f".{d}" if domains is R.FREE_TLDS else d: k for k, (domains, *_) in reversed(list(enumerate(DOMAIN_LISTS))) for d in domains}
    table = F.create_map(*[F.lit(x) for x in chain(*places.items())])
    top = F.when(F.contains(host, F.lit(".")), F.array(F.concat(F.lit("."), F.substring_index(host, ".", -1)))).otherwise(F.array().cast("array<string>"))
    return F.array_min(F.transform(F.concat(suffixes(host), top), lambda d: table[d]))


def _verdict(severity: str, confidence: str, label: str) -> Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(confidence).alias("confidence"), F.lit(label).alias("label"))


def _first_case(u: Column) -> Column:
    """The verdict on struct(low, host, ip): the first case that fits."""
    low, host, ip = u["low"], u["host"], u["ip"]
    v6 = F.contains(low, F.lit("[")) & host.rlike(r"^[0-9a-f:]*:[0-9a-f:.]*$")
    case = F.when(low.rlike(R.WEBHOOK_WHOLE), _verdict(R.WARNING, R.HIGH, "Discord webhook"))
    case = case.when(low.rlike(R.WEBHOOK), _verdict(R.REVIEW, R.MEDIUM, "webhook address without its token"))
    for fragment, label in R.EXFIL_FRAGMENTS.items():
        case = case.when(F.contains(low, F.lit(fragment)), _verdict(R.WARNING, R.HIGH, label))
    case = case.when(F.contains(low, F.lit("[")) & low.rlike(r"://[^/?#]*\[[^\]]*$"), _verdict(R.INFO, R.LOW, "unparseable URL"))
    case = case.when(is_private_ipv4(ip) | (v6 & host.rlike("^(::1?|f[cd].*|fe[89ab].*)$")), _verdict(R.INFO, R.HIGH, "local or private address"))
    case = case.when(ip.isNotNull() | v6, _verdict(R.REVIEW, R.MEDIUM, "bare IP address"))
    case = case.when(host.isin("cdn.discordapp.com", "media.discordapp.net") & F.contains(low, F.lit("/attachments/")), _verdict(R.REVIEW, R.MEDIUM, "chat attachment"))
    by_place = F.array(*[_verdict(*said) for _, *said in DOMAIN_LISTS])
    return case.otherwise(F.coalesce(F.get(by_place, domain_place(host)), _verdict(R.INFO, R.MEDIUM, "other domain")))


def classify_url(url: Column) -> Column:
    """struct(severity, confidence, label): the first case that fits. Host and address are taken once a URL."""
    host = host_of(url)
    parts = F.transform(F.array(F.struct(F.lower(url).alias("low"), host.alias("host"))), lambda u: F.struct(u["low"], u["host"], ipv4_number(u["host"]).alias("ip")))
    return F.transform(parts, _first_case)[0]
