import ipaddress
import random

from pyspark.sql import functions as F

from visitlens.functions.ip import address_hex, in_subnet, prefix_of, subnet24, subnet_of
from visitlens.operators import ranges, skew
from visitlens.operators.ranges import attach, flatten, located, networks, prepared

GOOD = ["1.2.3.4", "255.255.255.255", "0.0.0.0", "::", "::1", "2001:db8::1", "2001:DB8:0:0:1:0:0:1", "fe80::a:b", "1:2:3:4:5:6:7:8", "1::"]
BAD = ["", "1.2.3", "1.2.3.256", "1.2.3.4.5", "abc", "1::2::3", "12345::", "1:2:3:4:5:6:7:8:9", "g::1", "::1%eth0"]


def test_address_text(spark):
    df = spark.createDataFrame([(t,) for t in GOOD + BAD], "ip string")
    got = {r.ip: r.h for r in df.withColumn("h", address_hex(F.col("ip"))).collect()}
    for t in GOOD:
        a = ipaddress.ip_address(t)
        assert got[t] == f"{int(a):0{8 if a.version == 4 else 32}x}", t
    assert [t for t in BAD if got[t] is not None] == []


def test_mapped_addresses_count_as_v4(spark):
    df = spark.createDataFrame([("::ffff:1.2.3.4",), ("::ffff:102:304",), ("0:0:0:0:0:ffff:0102:0304",)], "ip string")
    assert {r[0] for r in df.select(address_hex(F.col("ip"))).collect()} == {"01020304"}


def test_prefix_equals_network_membership(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(300):
        version = rng.choice((4, 6))
        size = 32 if version == 4 else 128
        bits = rng.randint(0, size)
        a = rng.getrandbits(size)
        b = a ^ rng.getrandbits(max(size - bits - rng.choice((-1, 0, 1)), 0)) & ((1 << size) - 1)
        cls = ipaddress.IPv4Address if version == 4 else ipaddress.IPv6Address
        net = ipaddress.ip_network((int(cls(a)) if version == 4 else cls(a), bits), strict=False)
        rows.append((str(cls(a)), str(cls(b)), bits, cls(b) in net))
    df = spark.createDataFrame(rows, "a string, b string, bits int, want boolean")
    same = prefix_of(address_hex(F.col("a")), F.col("bits")) == prefix_of(address_hex(F.col("b")), F.col("bits"))
    assert df.where(same != F.col("want")).count() == 0


def test_subnets(spark):
    cases = [
        ("10.1.2.3", "10.1.2.0/24", "10.1.2.0/24", "10.1.2.0/24"),
        ("2001:db8::1", "2001:db8:1::/64", "2001:db8:0:0::/64", "2001:d00::/24"),
        ("2001:db8:1:2:3:4:5:6", "2001:db8:1:2::/64", "2001:db8:1:2::/64", "2001:d00::/24"),
        ("2001:0:1:2:3:4:5:6", "2001:0:1:2::/64", "2001:0:1:2::/64", "2001::/24"),
        ("::1", "1::/64", "0:0:0:0::/64", "::/24"),
        ("0:db8::1", "0:db8:1::/64", "0:db8:0:0::/64", "0:d00::/24"),
    ]
    df = spark.createDataFrame([c[:1] for c in cases], "ip string")
    ip = F.col("ip")
    got = df.select(ip, subnet_of(ip), subnet_of(ip, strict=True), subnet24(ip)).collect()
    assert [tuple(r) for r in got] == cases


def test_home_subnets(spark):
    df = spark.createDataFrame([("2405:9800:b911:2816::1",), ("2405:9800:b911:2817::1",), ("10.1.2.9",)], "ip string")
    v6, v4 = in_subnet(F.col("ip"), "2405:9800:b911:2816::/64"), in_subnet(F.col("ip"), "10.1.2.0/24")
    assert [tuple(r) for r in df.select(v6, v4).collect()] == [(True, False), (False, False), (False, True)]


def _random_networks(rng, n):
    nets = set()
    for _ in range(n):
        if rng.random() < 0.6:
            nets.add(str(ipaddress.ip_network((rng.getrandbits(32) & 0x0F0F0F0F, rng.randint(2, 32)), strict=False)))
        else:
            high = rng.getrandbits(16) << 112 | rng.getrandbits(3) << 62
            nets.add(str(ipaddress.ip_network((ipaddress.IPv6Address(high), rng.randint(1, 128)), strict=False)))
    return sorted(nets)


def test_lookup_agrees_with_brute_force(spark):
    rng = random.Random(11)
    nets = _random_networks(rng, 150)
    ips = [str(ipaddress.IPv4Address(rng.getrandbits(32) & 0x0F0F0F0F)) for _ in range(300)]
    ips += [str(ipaddress.ip_network(n).network_address) for n in nets] + ["not an address", "::ffff:1.2.3.4"]
    parsed = [ipaddress.ip_network(n) for n in nets]
    table = networks(spark.createDataFrame([(n, n) for n in nets], "network string, label string"))
    events = spark.createDataFrame([(i, ip) for i, ip in enumerate(ips)] + [(9999, None)], "id long, client_ip string")
    got = {r.id: r.label for r in attach(events, {"hit": table}).select("id", "hit.label").collect()}
    assert len(got) == len(ips) + 1 and got[9999] is None
    for i, ip in enumerate(ips):
        try:
            a = ipaddress.ip_address(ip)
        except ValueError:
            assert got[i] is None
            continue
        a = getattr(a, "ipv4_mapped", None) or a
        hits = [n for n in parsed if n.version == a.version and a in n]
        want = str(max(hits, key=lambda n: n.prefixlen)) if hits else None
        assert got[i] == want, ip


def test_flattened_tables_are_disjoint_and_complete(spark):
    """Every place has the innermost block, and no two neighbours are one place."""
    rng = random.Random(5)
    nets = _random_networks(rng, 120) + ["0.0.0.0/0", "255.255.255.255/32", "255.255.255.0/24", "10.0.0.0/8", "10.0.0.0/9", "::/0", "ffff::/16", f"{'ffff:' * 7}ffff/128"]
    parsed = [ipaddress.ip_network(n) for n in sorted(set(nets))]
    for some in (parsed, [n for n in parsed if n.prefixlen]):
        rows = flatten(networks(spark.createDataFrame([(str(n), str(n)) for n in some], "network string, label string"))).collect()
        assert len({(r.family, r.at) for r in rows}) == len(rows)
        edges = {4: {0}, 6: {0}}
        for n in some:
            edges[n.version] |= {int(n.network_address), int(n.broadcast_address) + 1}
        want = {}
        for version, size in ((4, 32), (6, 128)):
            for at in edges[version] - {1 << size}:
                hits = [n for n in some if n.version == version and int(n.network_address) <= at <= int(n.broadcast_address)]
                want[version, f"{at:0{size // 4}x}"] = str(max(hits, key=lambda n: n.prefixlen)) if hits else None
        assert {(r.family, r.at): r.holds.label if r.holds else None for r in rows} == want


def test_two_prepared_tables_and_many_ranges(spark):
    rng = random.Random(3)
    one, two = _random_networks(rng, 60), _random_networks(rng, 9)
    ips = [str(ipaddress.IPv4Address(rng.getrandbits(32) & 0x0F0F0F0F)) for _ in range(200)] + [str(ipaddress.ip_network(n).network_address) for n in one + two]
    tables = {name: networks(spark.createDataFrame([(n, n) for n in nets], "network string, label string")) for name, nets in (("one", one), ("two", two))}
    addresses = spark.createDataFrame([(ip,) for ip in sorted(set(ips))] + [("none",)], "client_ip string")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "41")
    try:
        flat = {name: prepared(t) for name, t in tables.items()}
        got = {r.client_ip: (r.one and r.one.label, r.two and r.two.label) for r in located(addresses, flat).collect()}
        assert prepared(flat["one"]) is flat["one"]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got.pop("none") == (None, None) and len(got) == len(set(ips))
    for ip, labels in got.items():
        a = ipaddress.ip_address(ip)
        a = getattr(a, "ipv4_mapped", None) or a
        for nets, label in zip((one, two), labels, strict=True):
            hits = [n for n in map(ipaddress.ip_network, nets) if n.version == a.version and a in n]
            assert label == (str(max(hits, key=lambda n: n.prefixlen)) if hits else None)


def test_a_prepared_lookup_reads_events_twice_and_tries_nothing(spark, tmp_path, monkeypatch):
    spark.range(100).selectExpr("id", "concat('10.0.', id % 7, '.', id) as client_ip").write.parquet(str(tmp_path / "events"))
    table = prepared(networks(spark.createDataFrame([("10.0.0.0/8", "x"), ("10.0.3.0/24", "y")], "network string, label string")))
    # Prefix lengths are tried for a table that was not prepared only.
    monkeypatch.setattr(ranges, "innermost", None)
    found = attach(spark.read.parquet(str(tmp_path / "events")), {"hit": table})
    assert {r[0] for r in found.where("client_ip like '10.0.3.%'").select("hit.label").distinct().collect()} == {"y"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    # The first pass over the events ended when the distinct addresses were staged.
    assert plan.count("InMemoryFileIndex") - plan.count("per-key") == 1


def test_lookup_plan_has_no_nested_loop(spark):
    table = networks(spark.createDataFrame([("10.0.0.0/8", "x")], "network string, label string"))
    events = spark.createDataFrame([(1, "10.0.0.1")], "id long, client_ip string")
    plan = attach(events, {"hit": table})._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_salted_join_equals_plain_join(spark):
    events = spark.range(2000).selectExpr("id", "if(id % 3 = 0, 'hot', concat('ip', id % 40)) as client_ip")
    per_ip = events.groupBy("client_ip").agg(F.count("*").alias("_rows"), F.max("id").alias("m"))
    per_ip = per_ip.where("client_ip <> 'ip7'")
    events = events.unionByName(spark.createDataFrame([(5000, None), (5001, None)], "id long, client_ip string"))
    for how in ("left", "inner"):
        got, want = (
            sorted(map(tuple, df.select("id", "client_ip", F.coalesce("m", F.lit(-1))).collect()), key=repr)
            for df in (skew.spread_join(events, per_ip, "client_ip", "_rows", how, share=10), events.join(per_ip, "client_ip", how))
        )
        assert got == want


def test_heavy_keys_are_salted_under_adaptive_execution(spark):
    assert spark.conf.get("spark.sql.adaptive.enabled") == "true"
    events = spark.range(5000).selectExpr("id", "if(id % 5 < 4, 'hot', concat('ip', id)) as client_ip")
    per_ip = events.groupBy("client_ip").agg(F.count("*").alias("_rows"))
    joined = skew.spread_join(events, per_ip, "client_ip", "_rows")
    assert "_salt" in joined._jdf.queryExecution().executedPlan().toString()
    per_task = spark.range(5000).selectExpr("id", "if(id % 5 < 4, 'hot', concat('ip', id)) as client_ip")
    salts = per_task.select(F.pmod(F.xxhash64("id"), F.lit(skew.SALTS)).alias("s")).groupBy("s").count()
    assert salts.agg(F.max("count")).first()[0] < 5000 / 30
