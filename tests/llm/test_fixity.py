"""Audits against a plain comparison of the two replicas."""

import hashlib
from collections import Counter

from tarnspark.llm import fixity

FIELDS = ["page_id", "url", "html"]


def table(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, hash string")


def plain(a, b):
    x, y = ({k: Counter(r for r in rows if r[0] == k) for k in {r[0] for r in rows}} for rows in (a, b))
    return sorted(((k is None, k or 0), "missing" if k not in y else "extra" if k not in x else "altered") for k in {*x, *y} if x.get(k) != y.get(k))


def run(spark, a, b):
    rows, info = fixity.audit(table(spark, a), table(spark, b), "page_id", FIELDS)
    got = [r.asDict() for r in rows.collect()]
    assert sorted(((r["page_id"] is None, r["page_id"] or 0), r["status"]) for r in got) == plain(a, b)
    assert all(r["range_start"] <= r["page_id"] < r["range_end"] for r in got if r["page_id"] is not None)
    return info


def test_damage_is_found(spark):
    a = [(i, f"u{i}", "h" * (i % 50)) for i in range(1500)] + [(None, "u", None), (3, "again", ""), (3, "again", ""), (10**15, "far", "x"), (-5, "neg", None)]
    b = [r for r in a if r[0] not in (77, 1023)]
    b = [(i, u, "?" if i in (256, 700) else h) for i, u, h in b] + [(5000, "new", None), (3, "again", "")]
    b = [(i, u, "" if i == -5 else h) for i, u, h in b]
    info = run(spark, a, b)
    assert info["roots"][0] != info["roots"][1] and info["depth"] > 3
    assert info["levels"][-2].count() <= 9  # only ranges with damage were opened


def test_alike_and_empty(spark):
    a = [(i, "u", "h") for i in range(600)]
    assert len(set(run(spark, a, a[::-1])["roots"])) == 1
    run(spark, a, [])
    run(spark, [], [])


def test_rule_damage(spark):
    pages = table(spark, [(i, f"u{i}", None if i % 9 == 0 else f"<p>{i}") for i in range(700)]).drop("hash")
    rows, _ = fixity.audit(pages, fixity.damaged(pages), "page_id", FIELDS)
    got = Counter(r["status"] for r in rows.collect())
    assert got == Counter(altered=sum(i % 101 == 13 and i % 211 != 29 for i in range(700)), missing=sum(i % 211 == 29 for i in range(700)), extra=sum(i % 307 == 7 for i in range(700)))


def test_records_and_their_bytes(spark):
    """Byte offsets name the damaged records inside the archive's bytes."""
    rows = [(i, None if i == 5 else f"http://é{i}.example", None if i == 6 else "漢" * (i % 7)) for i in range(900)] + [(3, "again", "x"), (None, "u", "long " * 40_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    made = {}
    for r in fixity.warc(pages).collect():
        made.setdefault(r["page_id"], []).append(r["record"].encode())
    for k, html in ((4, "漢" * 4), (6, "")):
        head, _, rest = made[k][0].partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and f"Content-Length: {len(html.encode())}".encode() in head and rest == html.encode() + b"\r\n\r\n"
        assert hashlib.sha256(html.encode()).hexdigest().encode() in head
    assert b"WARC-Target-URI" not in made[5][0] and b"WARC-Truncated" in made[6][0]
    archive = b"".join(b"".join(sorted(made[k])) for k in sorted(made, key=lambda k: (k is not None, k or 0)))
    changed = spark.createDataFrame([(i, u, "?" if i in (3, 300) else h) for i, u, h in rows if i != 77] + [(5000, "new", "")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in fixity.audit_warc(fixity.warc(pages), fixity.warc(changed)).collect()}
    assert {k: r["status"] for k, r in got.items()} == {3: "altered", 300: "altered", 77: "missing", 5000: "extra"}
    for k in (3, 300, 77):
        at = archive[got[k]["byte_offset"] :][: got[k]["byte_length"]]
        assert at == b"".join(sorted(made[k]))
    empty = fixity.warc(pages.limit(0))
    assert fixity.audit_warc(empty, empty).count() == 0 and fixity.audit_warc(fixity.warc(pages), empty).count() == 901
