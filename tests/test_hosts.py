"""Hosts of odd URLs, as the URL standard has them."""

from pyspark.sql import functions as F

from quillwatch.functions import urls

# URL and host.
ODD = [
    ("https://a b/", None), ("http://1.2.3/", "1.2.0.3"), ("https://bücher.de/", "xn--bcher-kva.de"), ("https:\\\\evil.com", "evil.com"),
    ("https:/a.org", "a.org"), ("  https://a.org  ", "a.org"), ("https:a.org", "a.org"), ("ht\ntps://a.org", "a.org"),
    ("https://user:p@ss@h.org:443/x", "h.org"), ("https://h.org:65536", None), ("https://h.org:65535", "h.org"), ("https://h.org:8x", None),
    ("https://h.org:", "h.org"), ("https://@/", None), ("https://u@", None), ("http://0x7f.1", "127.0.0.1"), ("http://256.1.1.1", None),
    ("http://1.1.1.256", None), ("http://0300.0250.1", "192.168.0.1"), ("http://4294967296", None), ("http://4294967295", "255.255.255.255"),
    ("http://09", None), ("http://1.2.3.4.", "1.2.3.4"), ("http://a.1", None), ("http://1.a", "1.a"), ("http://[::1]", "[::1]"),
    ("http://[0:0:0:0:0:0:0:1]:80/", "[::1]"), ("http://[1:0:0:2:0:0:0:3]", "[1:0:0:2::3]"), ("http://[::ffff:1.2.3.4]", "[::ffff:102:304]"),
    ("http://[1::2::3]", None), ("http://[g::1]", None), ("http://[2001:DB8:0:0:1:0:0:1]", "[2001:db8::1:0:0:1]"), ("http://[::]", "[::]"),
    ("http://[1:2:3:4:5:6:7:8]", "[1:2:3:4:5:6:7:8]"), ("http://[1:2:3:4:5:6:7:8:9]", None), ("http://[1:2]", None), ("http://[::1", None),
    ("https://%41.org", "a.org"), ("https://a%2fb", None), ("https://a%zz", None), ("https://ＡＢ.org", "ab.org"), ("https://a。org", "a.org"),
    ("HTTPS://EXAMPLE.COM:80", "example.com"), ("https://a_b.c", "a_b.c"), ("https://a<b", None), ("https://", None), ("https:///x.org", "x.org"),
    ("http://x.org\\@y.org", "x.org"), ("ftp://x", None), ("data:x", None), ("//x.org", None), ("", None), (None, None), ("https://x.org?@y", "x.org"),
    ("https://x.org#@y", "x.org"), ("https://a..b", "a..b"), ("https://localhost:3000/x", "localhost"), ("http://0x", "0.0.0.0"),
    ("http://1..2", None), ("http://x.org:00000080", "x.org"), ("http://a\tb.org", "ab.org"), ("http://[::1.2.3]", None),
    ("http://[::256.1.1.1]", None), ("http://a+b.org", "a+b.org"), ("http://x.org:99999999999999999999999999999999999999999", None),
    ("not http", None), ("x http://a.org", None), ("http://­.org", None),
]


def test_odd_urls(spark):
    df = spark.createDataFrame([(k, u) for k, (u, _) in enumerate(ODD)], "k int, u string")
    got = {r["k"]: r["h"] for r in df.select("k", urls.host(F.col("u")).alias("h")).collect()}
    assert [(u, got[k]) for k, (u, _) in enumerate(ODD)] == ODD


def test_hosts_stay_in_the_jvm(spark):
    plan = spark.range(1).select(urls.host(F.col("id").cast("string")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
