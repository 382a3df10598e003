"""Line rules and the url list join, by hand and by brute force."""

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from quizspark.llm import line_rules, url_filter

SPACE = " \t\n\x0b\x0c\r"


def plain_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i:i + 5]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(SPACE):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def test_base_measures(make):
    random.seed(3)
    texts = ["".join(random.choice("ab é#|\n\t  \x0b") for _ in range(random.randint(0, 300))) for _ in range(300)]
    texts += [None, "", "\n\n", "a b c d e a b c d e", "a b c d", "a b c d e", "x " * 5000, "q\nq\n q\nq \n\n", "ä" * 70_000]
    got = line_rules.judge(make(list(enumerate(texts))), carry=["doc_id"]).collect()
    for r in got:
        expected = plain_base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == expected, texts[r.doc_id]
        assert r.base_failed == (expected[0] < 10 or 100 * expected[4] > 20 * expected[0])
        assert r.kept in (True, False) and not (r.base_failed and r.kept)


def body(i):
    return " ".join(f"w{i}x{k}" for k in range(12))


def test_frequent_lines_and_depletion(make):
    menu = "Home  About\tContact us today for more"
    rows = [(i, f"{body(i)}\n{menu if i % 2 else menu.upper()}\n{body(i + 1000)}", "a") for i in range(20)]
    rows += [(100 + i, f"{menu}\n{body(5000)[:20]}" + f" only{i} two three four five", "a") for i in range(3)]
    rows += [(200 + i, f"{body(200)}\n{body(201)}", "a") for i in range(30)]  # copies make no line frequent
    rows += [(300 + i, f"{body(300 + i)}\n{menu}", None if i < 8 else "b") for i in range(10)]
    rows += [(7, rows[7][1], "a")]
    got = line_rules.judge(make(rows).withColumn("removed_lines", F.lit("old"))).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].removed_lines == 1 and by[i].removed_words == 7 and by[i].kept for i in range(20))
    assert by[3].clean_text == f"{body(3)}\n{body(1003)}"
    assert all(by[100 + i].removed_lines == 1 and by[100 + i].removed_words == 7 and not by[100 + i].kept for i in range(3))
    assert all(by[200 + i].removed_lines == 0 and by[200 + i].kept for i in range(30))
    assert [by[300 + i].removed_lines for i in range(10)] == [1] * 8 + [0] * 2
    assert line_rules.judge(make([])).count() == 0


def test_url_patterns(values):
    got = values(["https://u@A.b.Example.com.:80/x//y?q=/z#f", "http://h", None, "no url", "http:///p", "ftp://[::1]/a"], url_filter.patterns_of)
    assert got[0] == ["a.b.example.com", "b.example.com", "example.com", "com", "a.b.example.com/x", "a.b.example.com/x/y"]
    assert got[1] == ["h"] and got[2] == [] and got[3] == [] and got[4] == []


def test_list_join_against_brute_force(spark):
    random.seed(8)
    day = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
    patterns = ["b.com", "a.b.com", "A.b.com/x", "a.b.com/x/y", "com", "other.org", None]
    entries = [(random.choice(patterns), day(random.randint(0, 30)), random.choice(["block", "allow", None])) for _ in range(60)]
    entries += [("b.com", None, "block"), entries[0], entries[0]]
    urls = ["http://a.b.com/x/y/z", "http://a.b.com/x", "https://b.com", "http://b.com.", "http://c.b.com/x", "http://other.org/q", "bad", None]
    captures = [(i, random.choice(urls), day(random.randint(-2, 33)) if i % 9 else None, "old") for i in range(400)]
    captures += captures[:3]
    log = spark.createDataFrame(entries, "pattern string, listed_at timestamp, action string")
    got = url_filter.apply_list(spark.createDataFrame(captures, "id long, url string, fetched_at timestamp, action string"), log).collect()
    assert len(got) == len(captures)
    lists = {}
    for p, at, action in entries:
        if p and at and action:
            key = lists.setdefault(p.lower(), {})
            key[at] = max(key.get(at, ""), action)

    def keys(url):
        m = re.match(r"[a-z]+://([^/?#:]+)(/[^?#]*)?", url or "")
        if not m:
            return []
        host, segments = m[1].rstrip("."), [s for s in (m[2] or "").split("/") if s]
        labels = host.split(".")
        hosts = [".".join(labels[i:]) for i in range(len(labels))]
        return ["/".join([host, *segments[:n]]) for n in range(len(segments), 0, -1)] + hosts

    for r in got:
        best = (None, None)
        for k in keys(r.url) if r.fetched_at else []:
            past = [at for at in lists.get(k, {}) if at <= r.fetched_at]
            if past:
                best = k, lists[k][max(past)]
                break
        assert (r.pattern, r.action) == best and r.kept == (best[1] != "block"), r
    none = spark.createDataFrame([], "id long, url string, fetched_at timestamp")
    assert url_filter.apply_list(none, log).count() == 0
