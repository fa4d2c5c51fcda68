"""Addresses against the standard library's reading of them, and URLs that must not be fetched."""

import ipaddress
import random

from pyspark.sql import functions as F

from hireloom.functions.addresses import PRIVATE_V4, PRIVATE_V6, is_public, unsafe_url, v6_numbers
from hireloom.functions.urls import normalize_url


def model(text):
    try:
        a = ipaddress.ip_address(text.strip("[]"))
    except ValueError:
        return False
    if a.version == 6 and a.ipv4_mapped:
        a = a.ipv4_mapped
    if a.version == 4:
        return not any(ipaddress.ip_address(x) <= a <= ipaddress.ip_address(y) for x, y in PRIVATE_V4)
    return int(a) > 1 and not any(x <= int(a) >> 112 <= y for x, y in PRIVATE_V6)


def test_addresses(spark):
    rng = random.Random(6)
    texts = ["", "x", "1.2.3", "1.2.3.4.5", "256.1.1.1", "01.2.3.4", "::", "::1", "1::2::3", ":::", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "::1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", ":1:2:3:4:5:6:7", "12345::", "g::", "::ffff:1.2.3", "8.8.8.8", "[2606:4700::1111]", "2606:4700:0:0:0:0:0:1"]
    texts += [a for pair in PRIVATE_V4 for a in pair] + [str(ipaddress.ip_address(x) + d) for pair in PRIVATE_V4 for x, d in zip(pair, (-1, 1), strict=True) if 0 <= int(ipaddress.ip_address(x)) + d < 2**32]
    for _ in range(300):
        v4 = ipaddress.IPv4Address(rng.getrandbits(32))
        v6 = ipaddress.IPv6Address(rng.getrandbits(128) if rng.random() < 0.3 else (rng.choice([0xFC00, 0xFE80, 0xFEC0, 0xFF02, 0x2001, 0, rng.getrandbits(16)]) << 112) + rng.getrandbits(rng.choice([1, 16, 40])))
        texts += [str(v4), str(v6), v6.exploded, str(v6).upper(), f"::ffff:{v4}", f"::ffff:{int(v4) >> 16:x}:{int(v4) & 65535:x}", f"[{v6}]", f"{v6}x", f"{v4}."]
    rows = spark.createDataFrame([(t,) for t in dict.fromkeys(texts)] + [(None,)], "t string").select("t", is_public(F.col("t")).alias("p"), v6_numbers(F.lower("t")).alias("n"))
    for r in rows.collect():
        assert r.p == (r.t is not None and model(r.t)), r.t
        if r.n is not None:
            assert sum(g << (112 - 16 * k) for k, g in enumerate(r.n)) == int(ipaddress.IPv6Address(r.t.lower())), r.t


def test_unsafe_urls(spark):
    rows = [
        ("https://x.test/a", ["8.8.8.8"], None, None), ("https://x.test/a", ["8.8.8.8", "10.0.0.1"], "URL resolved to a non-public network address.", "URL resolved to a non-public network address."), ("https://x.test/a", [], "URL resolved to a non-public network address.", "URL resolved to a non-public network address."),
        ("http://x.test/", ["8.8.8.8"], "URL must use public HTTPS.", "URL must use public HTTPS."), ("https://u:p@x.test/", ["8.8.8.8"], "URL must not contain credentials.", "URL must not contain credentials."), ("http://localhost:1/", None, "URL must use public HTTPS.", None),
        ("https://127.0.0.1/", None, "Loopback URLs are not allowed.", None), ("https://[::1]/", None, "Loopback URLs are not allowed.", None), ("https://169.254.169.254/", ["8.8.8.8"], "URL resolved to a non-public network address.", "URL resolved to a non-public network address."), ("nothing", None, "URL is malformed.", "URL is malformed."), (None, None, "URL is malformed.", "URL is malformed."),
    ]
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "u string, a array<string>, strict string, test string, k int")
    for r in df.select("*", unsafe_url(F.col("u"), F.col("a")).alias("x"), unsafe_url(F.col("u"), F.col("a"), True).alias("y")).collect():
        assert (r.x, r.y) == (r.strict, r.test), r.u


def test_dot_segments_of_any_depth(spark):
    def resolved(path):
        out, segments = [], path.split("/")[1:]
        for k, s in enumerate(segments):
            if s == "..":
                out = out[:-1]
            elif s != ".":
                out.append(s)
            if s in (".", "..") and k == len(segments) - 1:
                out.append("")
        return "/" + "/".join(out)

    rng = random.Random(1)
    paths = ["/" + "/".join(rng.choice(["a", "b", "..", ".", "", "c.d", "..."]) for _ in range(rng.randrange(1, 20))) for _ in range(300)] + ["/" + "a/" * 40 + "../" * 39 + "x", "/..", "/.", "/a/..", "//", "/%2e%2E/a", "/a/%2e./b"]
    rows = spark.createDataFrame([(p, f"https://x.test{p}") for p in paths], "p string, u string").select("p", normalize_url(F.col("u"))["value"].alias("v"))
    for r in rows.collect():
        assert r.v == "https://x.test" + resolved(r.p.replace("%2e", ".").replace("%2E", ".")), r.p
