"""Links against Python's own address parser."""

import ipaddress
import random

from sheetgraph.operators import cleaning

FORBIDDEN = [ipaddress.ip_network(n) for n in ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "224.0.0.0/3", "::/127", "fc00::/7", "fe80::/16")]


def private(ip):
    ip = ip.ipv4_mapped or ip if ip.version == 6 else ip
    return any(ip in n for n in FORBIDDEN if n.version == ip.version)


def test_addresses_in_every_notation(spark):
    rng = random.Random(11)
    links = []
    for n in FORBIDDEN:
        for ip in (n[0], n[-1], n[rng.randrange(min(n.num_addresses, 1 << 60))]):
            links.append((ip, None))
        for ip in (int(n[0]) - 1, int(n[-1]) + 1):
            if 0 <= ip < 1 << n.max_prefixlen:
                links.append((ipaddress.ip_address(ip) if n.version == 4 else ipaddress.IPv6Address(ip), None))
    links += [(ipaddress.ip_address(rng.getrandbits(32)), None) for _ in range(60)] + [(ipaddress.IPv6Address(rng.getrandbits(128)), None) for _ in range(20)]
    rows = []
    for ip, _ in links:
        if ip.version == 6:
            forms = [f"[{ip}]", f"[{ip.exploded}]", f"[{str(ip).upper()}]"]
        else:
            a, b, c, d = ip.packed
            forms = [str(ip), str(int(ip)), hex(int(ip)), f"0{a:o}.{b}.0x{c:x}.{d}", f"{a}.{b}.{c * 256 + d}", f"{a}.{int(ip) & 0xFFFFFF}", f"[::ffff:{ip}]", f"[::ffff:{a * 256 + b:x}:{c * 256 + d:x}]", f"{ip}."]
        for host in forms:
            want = "private_host" if private(ip) else "ok"
            rows += [(f"http://{host}/x", want), (f"https://user:pw@{host}:8443?q", want), (f"http://{host}:22/", "port")]
    rows += [("http://1.2.3.4.5/", "invalid"), ("http://256.1.1.1/", "invalid"), ("http://1.2.3.256", "invalid"), ("http://4294967296/", "invalid"), ("http://09.1.1.1/", "invalid"), ("http://[::1", "invalid"), ("http://[1:2]/", "invalid"), ("http://[::ffff:1.2.3.300]/", "invalid")]
    rows += [("http://localhost/", "private_host"), ("http://a.localhost:80/", "private_host"), ("http://example.com@10.0.0.1/", "private_host"), ("http://10.0.0.1@example.com/", "ok"), ("ftp://example.com/", "scheme"), ("no link", "invalid"), (None, "invalid"), ("http:///x", "invalid")]
    rows += [("http://example.com:0443/", "ok"), ("HTTP://Example.COM", "ok"), ("http://10.example.com/", "ok"), ("http://fc00.example/", "ok"), ("http://a:b/", "invalid"), ("http:\\\\10.0.0.1\\", "private_host")]
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string")
    got = {r["page_id"]: r["result"] for r in cleaning.url_check(df).collect()}
    assert not [(u, got[i], want) for i, (u, want) in enumerate(rows) if got[i] != want]
