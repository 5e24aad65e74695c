from __future__ import annotations

import hashlib
import random
import re

from kelpline.llm.pii import BASE, KINDS, candidates, find_personal_data, fit


def luhn(d: str) -> bool:
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text: str | None) -> str:
    t, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for k, pattern in ((2, r"[0-9]([\x20-]?[0-9])+"), (3, r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            if (14 <= len(d) <= 19 and luhn(d)) if k == 2 else 10 <= len(d) <= 15:
                out.append((m.start(), k, m.end()))
    return ",".join(f"{BASE[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_base_spans_match_brute_force(spark):
    r = random.Random(4)
    texts = ["".join(r.choice("a1.@+- (9)50é\n") for _ in range(r.randrange(90))) for _ in range(1500)]
    texts += ["a@b.com_x@c.de 4111 1111 1111 1111 1.2.3.4.5.6.7.8 000001.2.3.4 +1 (377) 555-0271", "é😀 x@y.org", "4111-1111-1111-1111x", "999.1.1.1 1.1.1.1", None, ""]
    texts.append("9" * 20000 + "a" * 20000 + "@x.y" + ".z" * 2000)
    rows = list(enumerate(texts))
    got = find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    for x in got:
        want = brute(texts[x.doc_id])
        assert x.base_sha256 == hashlib.sha256(want.encode()).hexdigest(), texts[x.doc_id]
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(s.startswith(k + ":") for s in want.split(",")) for k in BASE]
        assert set(filter(None, want.split(","))) <= set(x.spans.split(","))


def test_method_adds_supported_spans_only(spark):
    good = ["call me on (555) 212-3344 please", "api_key = 0123456789abcdef0123456789abcdef", "write to joe (at) example (dot) com", "your token = 'a8f3k2m9x7q1w5e4r6t8y0u2i4o6p8a1'"]
    rows = [(i, good[i % len(good)] + f" n{i}") for i in range(200)] + [(1000 + i, f"plain words number {i} only") for i in range(200)]
    got = {x.doc_id: x for x in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].n_added == 0 and got[i].spans == "" for i in got if i >= 1000)
    assert sum(got[i].n_added for i in got if i < 1000 and i % 4 == 1) >= 45


def test_em_finds_reliable_labelers():
    """Three labelers agree with a hidden class nine times in ten; one is a coin."""
    r, counts = random.Random(1), {}
    for _ in range(4000):
        y = r.random() < 0.5
        v = tuple((1 if y else -1) * (1 if r.random() < 0.9 else -1) for _ in range(3)) + (r.choice((-1, 1)),)
        counts[(5, v)] = counts.get((5, v), 0) + 1
    m = fit([(k, v, c) for (k, v), c in sorted(counts.items())])
    assert all(m.reliability[j][1] > 0.8 and m.reliability[j][0] < 0.2 for j in range(3))
    assert abs(m.reliability[3][1] - 0.5) < 0.1


def test_odd_rows(odd_docs, no_docs):
    assert find_personal_data(odd_docs).count() == odd_docs.count()
    assert find_personal_data(no_docs).collect() == []


def test_plan_is_native(odd_docs):
    plan = candidates(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow")) and len(KINDS) == 9


def test_many_matches_take_time_in_proportion(spark):
    import time

    unit = "mail bob@example.com or 10.0.0.1 now. "
    rows = spark.createDataFrame([(1, unit * 20_000)], "doc_id long, text string")
    began = time.time()
    (got,) = find_personal_data(rows).select("n_email", "n_ip", "spans").collect()
    assert (got.n_email, got.n_ip) == (20_000, 20_000) and time.time() - began < 120
    last = len(unit) * 19_999
    assert got.spans.split(",")[-2:] == [f"email:{last + 5}:{last + 20}", f"ip:{last + 24}:{last + 32}"]
