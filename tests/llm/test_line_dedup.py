"""Line dedup against plain counting."""

import random
from collections import Counter, defaultdict

from tidepool.llm import line_dedup
from tidepool.llm.line_dedup import drop_boilerplate


def plain(rows, ratio, least, fold=False):
    pages, seen = defaultdict(list), Counter()
    for _, host, text in rows:
        pages[host].append(text or "")
    if fold:
        pages = {host: set(texts) for host, texts in pages.items()}
    for host, texts in pages.items():
        for t in texts:
            seen.update((host, x) for x in {x.strip(" ") for x in t.split("\n")} - {""})
    out = []
    for d, host, text in rows:
        if text is None:
            out.append((d, None, 0))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if not (seen[host, x.strip(" ")] >= least and seen[host, x.strip(" ")] > ratio * len(pages[host]))]
        out.append((d, "\n".join(kept), len(lines) - len(kept)))
    return out


def test_lines(spark, monkeypatch):
    r = random.Random(4)
    rows = []
    for d in range(300):
        host = r.choice(["a", "b", None, "hot", "hot", "hot"])
        lines = [r.choice(["menu", "  menu ", "footer %s" % host, "", "rare %d" % r.randrange(90), "own %d" % d]) for _ in range(r.randrange(0, 6))]
        rows.append((d, host, "\n".join(lines)))
    rows += [(d, "copied", "the same page\nagain") for d in range(400, 430)] + [(d, "copied", "page %d" % d) for d in range(430, 470)]
    rows += [(None, "a", "menu\nx"), (900, "a", None), (901, "one", "menu"), (902, "a", "menu\nx" * 20_000)]
    df = spark.createDataFrame([(*x, 1, "y") for x in rows], "doc_id long, source string, text string, n_dropped int, host string")
    for ratio, least, fold, most in [(0.05, 5, False, 32 << 20), (0.3, 2, True, 32 << 20), (0.05, 5, True, 0), (0.05, 5, False, 0)]:
        monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", most)
        monkeypatch.setattr(line_dedup, "MOST_HOT", 3)
        got = drop_boilerplate(df, ratio=ratio, min_pages=least, fold_copies=fold)
        assert sorted(got.columns) == sorted(["doc_id", "source", "text", "host", "n_dropped"])
        assert sorted(((x.doc_id, x.text, x.n_dropped) for x in got.collect()), key=repr) == sorted(plain(rows, ratio, least, fold), key=repr)
    assert drop_boilerplate(df.limit(0)).collect() == []


def test_columns_that_clash(spark):
    """Whatever a table's columns are called, they come out as they went in."""
    names = ["_host", "_lines", "_pages", "_kept", "_HOST_", "__lines", "host", "line_id", "page", "n_pages", "n_host"]
    rows = [(d, "a", f"menu\nown {d}", *[f"{c}{d}" for c in names]) for d in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string, " + ", ".join(f"{c} string" for c in names))
    for most in (32 << 20, 0):
        line_dedup.BROADCAST_BYTES, before = most, line_dedup.BROADCAST_BYTES
        got = {r.doc_id: r for r in drop_boilerplate(df).collect()}
        line_dedup.BROADCAST_BYTES = before
        assert len(got) == 20
        for d, r in got.items():
            assert r.text == f"own {d}" and r.n_dropped == 1 and [r[c] for c in names] == [f"{c}{d}" for c in names]
