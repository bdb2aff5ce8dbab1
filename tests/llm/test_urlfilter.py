import math
import random
from collections import defaultdict

import pytest

from opslens.llm import urlfilter

URLS = [
    None, "", "no scheme", "http://", "http://A.Example.ORG", "http://example.org/es/1", "x://www.example.org/en/12?q",
    "http://org/", "http://orgs/", "http://a.org", "https://shop.com/fr/x#y", "http://com/de/", "http://COM/DE/",
    "ftp://u:p@h.com:80/fr/?a=/de/", "http://h.net/a://b", "http://h.net?x/y", "http://h.net#/z", "http://é.ÉORG/x",
    "http://example.org/en/1", "http://notexample.org/es/", "http://example.org/es", "http://h.com/fr/\nz",
]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min((rest.index(c) for c in "/?#" if c in rest), default=len(rest))
    host, rest = rest[:cut], rest[cut:]
    path = rest[: min((rest.index(c) for c in "?#" if c in rest), default=len(rest))]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_for(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def strength(rows):
    top = sum((k - n * m) ** 2 / n - m * (1 - m) for n, k, m in rows if n)
    bottom = sum(m * (1 - m) * (n - 1) for n, k, m in rows if n)
    return 1e6 if top <= 0 or not bottom else min(max(bottom / top - 1, 1), 1e6)


def posteriors(hosts):
    """host -> (mean, bound) by the formulas, level by level."""
    total = [sum(c[i] for c in hosts.values()) for i in (0, 1)]
    above = {(): (total[1] + 1) / (total[0] + 2)}
    for depth in (1, 2, 3):
        counts = defaultdict(lambda: [0, 0])
        for host, (n, k) in hosts.items():
            names = host.split(".")
            key = (names[-1], ".".join(names[-2:]), host)[:depth]
            counts[key][0] += n
            counts[key][1] += k
        rows = {key: (n, k, above[key[:-1]]) for key, (n, k) in counts.items()}
        s = strength(list(rows.values()))
        above = {key: (k + s * m) / (n + s) for key, (n, k, m) in rows.items()}
    out = {}
    for key, mean in above.items():
        weight = rows[key][0] + s
        out[key[-1]] = (mean, max(mean - 1.645 * math.sqrt(mean * (1 - mean) / (weight + 1)), 0.0))
    return out


def test_parts_and_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)) * 2, "page_id bigint, url string")
    none = spark.createDataFrame([], "id bigint, bad boolean")
    found = urlfilter.judged(pages, none).collect()
    assert len(found) == 2 * len(URLS)
    for r in found:
        host, path = parts(URLS[r.page_id])
        rule, verdict = rule_for(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule), URLS[r.page_id]
        assert r.verdict == (verdict or "allow")


def test_reputation_matches_the_formulas(spark):
    rng = random.Random(8)
    hosts = [f"{a}.{b}.net" for a in ("www", "blog", "m", "x1", "x2") for b in ("good", "spam", "mixed")]
    rate = {"good": 0.02, "spam": 0.97, "mixed": 0.5}
    pages, outcomes, counts = [], [], {}
    for i in range(3000):
        host = hosts[int(rng.random() ** 3 * len(hosts))]
        pages.append((i, f"http://{host}/p{i}"))
        n = counts.setdefault(host, [0, 0])
        if i % 3:
            bad = rng.random() < rate[host.split(".")[1]]
            outcomes.append((i, bad))
            n[0] += 1
            n[1] += bad
    known = posteriors(counts)
    found = urlfilter.judged(
        spark.createDataFrame([(*p, "extra", "extra") for p in pages], "page_id bigint, url string, host string, n string"),
        spark.createDataFrame(outcomes + outcomes[:5], "id bigint, bad boolean"),
    ).collect()
    assert len(found) == 3000
    for r in found:
        mean, bound = known[r.host]
        assert (r.bad_rate, r.bound) == (pytest.approx(mean), pytest.approx(bound))
        assert r.verdict == ("block" if bound > 0.5 else "allow")
    assert {r.verdict for r in found} == {"block", "allow"}


def test_empty_tables(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string")
    labels = spark.createDataFrame([(1, None, None), (None, 0, 1)], "doc_id bigint, quality int, toxic int")
    assert urlfilter.judged(pages, urlfilter.page_outcomes(labels)).collect() == []


def test_too_many_rules():
    with pytest.raises(ValueError):
        urlfilter.matching_rule(None, None, (("allow", "a", "/"),) * 1001)
