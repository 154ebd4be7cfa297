import math
import random
import re
from collections import Counter, defaultdict
from urllib.parse import urlsplit

import pytest
from helpers import empty, frame, rows_of

from schemahelm.llm import queries, url_filter
from schemahelm.llm.url_filter import RULES, Rule, TreePlan

PAGES, LABELS = "page_id bigint, url string", "page_id bigint, good double"


def parse(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host):])[0]


def ruled(host, path):
    fits = [r for r in RULES if (host == r.domain or host.endswith("." + r.domain)) and path.startswith(r.prefix)]
    return max(fits, key=lambda r: len(r.text), default=None)


URLS = [None, "", "no scheme", "http://", "http://A.Example.ORG", "HTTPS://a.example.org/ES/", "x://example.org/es/1?x#y", "http://a.example.org/en/1",
        "http://a.example.org/en/12", "http://b.example.com/fr/x", "http://b.example.com/de/?", "http://notexample.org/es/", "http://com/de/", "http://b.com?/de/", "a://b://c/d",
        "http://org/", "http://org", "http://ÄB.org/é/", "http://h.net//a//b/", "http://h.net/" + "s/" * 30, "http://h.net/\nx y", "http://example.org:80/es/"]


def test_hosts_paths_and_rules(spark):
    got = {r["page_id"]: r for r in rows_of(url_filter.judge(frame(spark, list(enumerate(URLS)), PAGES), empty(spark, LABELS)))}
    assert len(got) == len(URLS)
    for i, url in enumerate(URLS):
        host, path = parse(url)
        rule = ruled(host, path)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule and rule.text), url
        assert got[i]["verdict"] == (rule.action if rule else "allow")


def test_whole_table(spark, sf_dir):
    pages = rows_of(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"))
    got = {r["page_id"]: r for r in rows_of(queries.op6_url_filter(spark, sf_dir))}
    assert len(got) == len(pages)
    for p in pages:
        host, path = parse(p["url"])
        assert host == urlsplit(p["url"]).netloc.lower() and path == urlsplit(p["url"]).path
        rule, r = ruled(host, path), got[p["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule.text)
        assert r["verdict"] == rule.action if rule else r["verdict"] in ("allow", "block")


def plain_templates(urls, plan):
    """Template of each (host, path) by going down level by level with counters."""
    def shape(x):
        for form, name in ((r"[0-9]+", "{number}"), (r"[0-9]+\.[A-Za-z0-9]{1,5}", "{number.ext}"), (r"(?=.*[0-9])[0-9A-Fa-f-]{8,}", "{hex}")):
            if re.fullmatch(form, x):
                return name
        return "{text}"

    parts = {u: re.sub("^/", "", u[1]).split("/") for u in urls}
    template, level = dict.fromkeys(urls, ""), 0
    while any(len(p) > level for p in parts.values()):
        counts = Counter()
        for u, n in urls.items():
            if len(parts[u]) > level:
                counts[u[0], template[u], parts[u][level]] += n
        template = {
            u: t if len(parts[u]) <= level else f"{t}/" + (parts[u][level] if shape(parts[u][level]) == "{text}" and counts[u[0], t, parts[u][level]] >= plan.repeats else shape(parts[u][level]))
            for u, t in template.items()
        }
        level += 1
    return template


def plain_rejected(rows, plan):
    """Rejected (host, template)s of rows (host, template, good or None)."""
    counts, outlines, hosts = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    outline = lambda t: re.sub(r"/(?!\{)[^/]+", "/{*}", t)
    for host, t, good in rows:
        for table, key in ((counts, (host, t)), (outlines, (host, outline(t))), (hosts, host)):
            table[key][0] += good is not None
            table[key][1] += good or 0
    merged, of = defaultdict(lambda: [0, 0]), {}
    for (host, t), (n, g) in counts.items():
        pooled_n, pooled_g = outlines[host, outline(t)]
        share = pooled_g / pooled_n if pooled_n else 0.5
        alike = n == 0 or abs(g / n - share) <= plan.z * math.sqrt(max(share * (1 - share), 0.01) / n)
        of[host, t] = (host, outline(t) if alike else t)
        merged[of[host, t]][0] += n
        merged[of[host, t]][1] += g
    prior = (sum(g for _, g in hosts.values()) + 1) / (sum(n for n, _ in hosts.values()) + 2)
    def purity(key):
        (n, g), (hn, hg) = merged[key], hosts[key[0]]
        return (g + plan.weight * (hg + plan.weight * prior) / (hn + plan.weight)) / (n + plan.weight)
    return {t for t, key in of.items() if purity(key) < plan.threshold}


def check_plain(spark, pages, labels, plan):
    """Templates and the method's verdicts of all pages against the plain versions."""
    got = rows_of(url_filter.judge(pages, labels, (), plan))
    urls = Counter((r["host"], r["path"]) for r in got)
    want = plain_templates(urls, plan)
    assert {(r["host"], r["path"]): r["template"] for r in got} == want
    marks = defaultdict(list)
    for r in rows_of(labels):
        marks[r["page_id"]].append(r["good"])
    good = {k: sum(v) / len(v) for k, v in marks.items()}
    rejected = plain_rejected([(r["host"], r["template"], good.get(r["page_id"])) for r in got], plan)
    assert {(r["host"], r["template"]) for r in got if r["verdict"] == "block"} == rejected
    return rejected


def test_tree_merge_and_purity_of_a_whole_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    labels = url_filter.document_labels(pages, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    for plan in (TreePlan(), TreePlan(repeats=2.0, z=0.5, weight=2.0, threshold=0.6)):
        check_plain(spark, pages, labels, plan)


def test_deep_branches_are_judged_apart(spark):
    rng = random.Random(3)
    urls = [f"http://h/a/b/c/d/e/f/{kind}/{i}" for kind in ("good", "bad") for i in range(100)]
    urls += ["http://k/" + "/".join(rng.choice(["x", "y", "7", "q1"]) for _ in range(rng.randrange(12))) for _ in range(200)] + [None, "http://z/" + "s/" * 40]
    pages = frame(spark, list(enumerate(urls)), PAGES)
    labels = frame(spark, [(i, 0.0 if "/bad/" in u else 1.0) for i, u in enumerate(urls) if u and i % 2 == 0], LABELS)
    rejected = check_plain(spark, pages, labels, TreePlan())
    assert ("h", "/a/b/c/d/e/f/bad/{number}") in rejected and ("h", "/a/b/c/d/e/f/good/{number}") not in rejected


def tree(spark, urls, plan=TreePlan()):
    pages = frame(spark, list(enumerate(urls)), PAGES)
    return {r["page_id"]: r["template"] for r in rows_of(url_filter.judge(pages, empty(spark, LABELS), (), plan))}


def test_segments_that_vary_become_wildcards(spark):
    urls = [f"http://h/{kind}/{i}" for kind in ("news", "blog") for i in range(20)] + [f"http://h/user/name{i}x/posts" for i in range(20)] + ["http://h/a/deadbeef01"]
    got = tree(spark, urls)
    assert set(got.values()) >= {"/news/{number}", "/blog/{number}", "/user/{text}/posts"}
    assert set(tree(spark, ["http://h/a/b/c/d/e/f/g/h/1"] * 4).values()) == {"/a/b/c/d/e/f/g/h/{number}"}


def test_purity_blocks_a_bad_branch_and_merges_like_ones(spark):
    urls, good = [], []
    for kind, share in (("news", 0.9), ("blog", 0.88), ("spam", 0.02)):
        for i in range(60):
            urls.append(f"http://h/{kind}/{i}")
            good.append(float(i % 50 < share * 50))
    pages = frame(spark, list(enumerate(urls)), PAGES)
    labels = frame(spark, [(i, g) for i, g in enumerate(good) if i % 2], LABELS)
    verdicts = {}
    for r in rows_of(url_filter.judge(pages, labels, ())):
        verdicts.setdefault(r["template"], set()).add(r["verdict"])
    assert verdicts == {"/news/{number}": {"allow"}, "/blog/{number}": {"allow"}, "/spam/{number}": {"block"}}
    placed = url_filter.path_templates(pages.select("page_id", *(c.alias(n) for c, n in zip(url_filter.split_url(pages.url), ("host", "path")))).groupBy("host", "path").count().withColumnRenamed("count", "n"), TreePlan())
    marks = pages.join(labels, "page_id", "left").select(url_filter.split_url(pages.url)[1].alias("path"), "good")
    purity = rows_of(url_filter.template_purity(placed.join(marks, "path"), TreePlan()))
    merged = {r["template"]: r["merged"] for r in purity}
    assert merged["/spam/{number}"] == "/spam/{number}" and merged["/news/{number}"] != "/spam/{number}"


def test_rules_of_equal_length_and_repeated_rows(spark):
    pages = frame(spark, [(1, "http://a.b/xy"), (1, "http://a.b/xy"), (None, "http://a.b/xy")], PAGES)
    got = rows_of(url_filter.judge(pages, frame(spark, [(1, 1.0), (1, 0.0), (None, 1.0), (2, None)], LABELS), (Rule("block", "b", "/xy"), Rule("allow", "a.b", "/"))))
    assert len(got) == 3 and {(r["rule"], r["verdict"]) for r in got} == {("a.b/", "allow")}
    assert rows_of(url_filter.judge(empty(spark, PAGES), empty(spark, LABELS))) == []


@pytest.mark.parametrize("url, doc", [("http://h/en/12", 12), ("http://h/en/12.html?x", 12), ("http://h/en/12/#a", 12), ("http://h/12/en", None), (None, None), ("http://h/" + "9" * 30, None)])
def test_labels_come_from_the_number_of_the_document(spark, url, doc):
    labels = frame(spark, [(12, 1), (12, None), (13, 0)], "doc_id bigint, quality int")
    got = rows_of(url_filter.document_labels(frame(spark, [(5, url)], PAGES), labels))
    assert got == ([{"page_id": 5, "good": 1.0}] if doc else [])


def test_a_bad_section_among_many_is_blocked(spark):
    """A host of 20 busy sections, one of them bad, and of segments that occur once."""
    urls = [f"http://h/section-{'abcdefghijklmnopqrst'[k]}/{i}" for k in range(20) for i in range(30)] + [f"http://h/misspelt-{'abcdefghij'[k]}/1" for k in range(10)]
    pages = frame(spark, list(enumerate(urls)), PAGES)
    labels = frame(spark, [(i, float("section-g" not in u)) for i, u in enumerate(urls) if i % 2], LABELS)
    verdicts = {}
    for r in rows_of(url_filter.judge(pages, labels, ())):
        verdicts.setdefault(r["template"], set()).add(r["verdict"])
    assert verdicts.pop("/section-g/{number}") == {"block"} and verdicts.pop("/{text}/{number}") == {"allow"}
    assert len(verdicts) == 19 and all(v == {"allow"} for v in verdicts.values())
