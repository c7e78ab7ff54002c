import random
from collections import Counter

import pytest

from evalloom.llm.line_dedup import RATIO, line_dedup

CLASHING = "page_id long, url string, html string, host string, lines string, keys int, key string, pages int, n int, parts int, bucket int"


def page(i, *lines, host="a.example"):
    return (i, f"https://user@{host}:80/x?y", "<html><script>var x='</p>';</script>" + "".join(f"<p>{x}</p>" for x in lines) + "</html>")


def plain(rows):
    """rows (page_id, host, lines) by counting."""
    pages, held = Counter(h for _, h, _ in rows), Counter((h, x) for _, h, lines in rows for x in set(lines))
    out = []
    for i, h, lines in rows:
        kept = [x for x in lines if held[h, x] < 2 or not held[h, x] / pages[h] > RATIO]
        out.append((i, h, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("few", [1_000_000, 0])
def test_against_counting(spark, few):
    """Hosts of all sizes, ties at the ratio, repeated rows and lines, a long page, clashing columns; both ways of looking lines up."""
    rng = random.Random(3)
    rows = []
    for h, n in (("big.example", 150), ("ten.example", 10), ("twenty.example", 20), ("two.example", 2), ("one.example", 1)):
        for k in range(n):
            lines = ["Menu", *(f"common {j}" for j in range(6) if rng.random() < 0.05 * (j + 1)), f"own {k} {h}", "Menu"] + (["tie"] if h == "twenty.example" and k < 2 else [])
            rng.shuffle(lines)
            rows.append((rng.randrange(10**6), h, lines))
    rows += [rows[0], rows[0], (None, "big.example", ["Menu", "x"]), (5, "", []), (6, "big.example", [f"line {k}" for k in range(20_000)] + ["Menu"] * 5000)]
    made = [(*page(i, *lines, host=h), "h", "l", 1, "k", 2, 3, 4, 5) if h else (i, None, None, "h", "l", 1, "k", 2, 3, 4, 5) for i, h, lines in rows]
    got = line_dedup(spark.createDataFrame(made, CLASHING).repartition(5), few_lines=few)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows)


def test_site_relative(spark):
    rows = [page(i, "Menu &amp; more", f"story  {i}", *(["some"] if i == 0 else [])) for i in range(20)] + [page(100 + i, "Menu &amp; more", host="b.example") for i in range(3)]
    rows += [(200, None, None), (None, "no host", "<b>x</b><br>y"), (200, None, None)]
    got = {}
    for r in line_dedup(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        got.setdefault(r.page_id, []).append(r)
    assert got[0][0].text == "story 0\nsome" and got[0][0].n_lines == 3 and got[0][0].n_dropped == 1 and got[0][0].host == "a.example"
    assert got[100][0].text == ""  # on all three pages of the host
    assert len(got[200]) == 2 and got[200][0].text == "" and got[None][0].text == "x\ny"


@pytest.mark.parametrize("few", [1_000_000, -1])
def test_empty(spark, few):
    assert line_dedup(spark.createDataFrame([], "page_id long, url string, html string"), few_lines=few).collect() == []
