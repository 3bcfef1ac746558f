"""Address and endpoint expressions."""
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
IPV4 = rf"^{OCTET}(?:\.{OCTET}){{3}}$"


def is_ipv4(ip: Column) -> Column:
    """True for dotted IPv4 text without leading zeros; false for NULL."""
    return F.coalesce(ip.rlike(IPV4), F.lit(False))


def is_private(ip: Column) -> Column:
    """IPv4 text in a range that is not globally routable."""
    return is_ipv4(ip) & ip.rlike(fixed.PRIVATE_PATTERN)


def is_enrichable(ip: Column) -> Column:
    """Public IPv4 that is not one of the excluded hosts."""
    public = ip.rlike(IPV4) & ~ip.isin(fixed.EXCLUDED_HOSTS) & ~ip.rlike(fixed.PRIVATE_PATTERN)
    return F.coalesce(public, F.lit(False))


def is_ipv6(ip: Column) -> Column:
    """IPv6 text, with an optional zone and an optional dotted tail."""
    plain = F.regexp_replace(ip, r"^([^%]+)%[^%]+$", "$1")
    plain = F.regexp_replace(plain, rf":{OCTET}(?:\.{OCTET}){{3}}$", ":0:0")
    groups = F.filter(F.split(plain, ":"), lambda g: g != "")
    short = plain.contains("::")
    hexes = F.forall(groups, lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$"))
    once = ~plain.contains(":::") & (F.size(F.split(plain, "::")) == 2)
    ends = ~plain.rlike("^:[^:]") & ~plain.rlike("[^:]:$")
    fits = F.when(short, once & (F.size(groups) <= 7)).otherwise(F.size(groups) == 8)
    return F.coalesce(plain.contains(":") & hexes & ends & fits, F.lit(False))


def is_ip(ip: Column) -> Column:
    return is_ipv4(ip) | is_ipv6(ip)


def admitted() -> Column:
    """TCP or UDP over IPv4."""
    return F.coalesce(F.col("proto").isin(6, 17) & is_ipv4(F.col("src_ip")) & is_ipv4(F.col("dst_ip")), F.lit(False))


def first_ipv4(message: Column) -> Column:
    """First IPv4-like text in a message, or NULL."""
    hit = F.regexp_extract(message, r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", 0)
    return F.when(hit != "", hit)


def flow_key(src_ip="src_ip", src_port="src_port", dst_ip="dst_ip", dst_port="dst_port",
             proto="proto") -> Column:
    """Direction-free flow key: the two endpoints in order, and the protocol."""
    a = F.struct(F.col(src_ip).alias("ip"), F.col(src_port).alias("port"))
    b = F.struct(F.col(dst_ip).alias("ip"), F.col(dst_port).alias("port"))
    return F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), F.col(proto).alias("proto"))
