import heapq
import random

import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from twinframe.llm import mixing, urls
from twinframe.llm.queries import QUERIES, URL_RULES


def brute_targets(sizes: dict, share=1.5, most=2):
    """Fills up by weight, stops what is above its bound, and shares the rest again."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, stopped = share * sum(sizes.values()), {}
    while True:
        rest = {s: weight[s] for s in order if s not in stopped}
        level = left / sum(rest.values()) if rest else 0.0
        over = [s for s in rest if rest[s] * level >= most * sizes[s]]
        if not over:
            return stopped | {s: w * level for s, w in rest.items()}
        for s in over:
            stopped[s] = float(most * sizes[s])
            left -= stopped[s]


def size(text):
    return len(cases.WORD.findall(text or ""))


@pytest.mark.parametrize("shard_words", [500, mixing.SHARD_WORDS])
def test_mix_meets_its_targets(spark, shard_words):
    rows = cases.documents()
    docs = cases.table(spark, rows).withColumn("target", F.lit("x")).withColumn("quota", F.lit(1)).withColumn("mix_size", F.lit("y"))
    mixed = mixing.mix(docs, shard_words=shard_words)
    found = mixed.collect()
    assert mixed.columns.count("mix_size") == 1 and len(found) == len(rows)
    sizes = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
    target, taken, shards = brute_targets(sizes), {}, {}
    for r in found:
        assert r.mix_size == size(r.text) and r.mix_source_size == sizes[r.source]
        assert r.mix_target == pytest.approx(target[r.source], abs=1e-6)
        assert 0 <= r.mix_taken <= 2 * r.mix_size
        assert r.mix_taken == r.mix_whole * r.mix_size + r.mix_run
        taken[r.source] = taken.get(r.source, 0) + r.mix_taken
        shards[r.source] = shards.get(r.source, 0) + r.mix_size + mixing.ROW_WORDS
    for s, t in target.items():
        near = mixing.BLOCK_WORDS * (1 + (shards[s] // shard_words if t > 1.9 * sizes[s] else 0))
        assert abs(taken[s] - t) <= near
    again = mixing.mix(docs.repartition(5, "n_chars"), shard_words=shard_words)
    key = lambda r: (str(r.doc_id), str(r.text)[:50], r.mix_taken)
    assert sorted(map(key, found)) == sorted(map(key, again.collect()))


def test_draw_gives_the_words_taken(spark):
    docs = cases.table(spark)
    mixed = {}
    for r in mixing.mix(docs).collect():
        mixed.setdefault(str(r.doc_id), 0)
        mixed[str(r.doc_id)] += r.mix_taken
    drawn = {}
    for r in mixing.draw(docs).collect():
        drawn.setdefault(str(r.doc_id), 0)
        drawn[str(r.doc_id)] += size(r.text)
    assert {k: v for k, v in mixed.items() if v} == drawn


def test_mix_of_nothing(spark):
    assert mixing.mix(cases.table(spark, [])).count() == 0
    blank = cases.table(spark, [(1, None, None, None, None), (2, "", None, "s", 0)])
    assert [r.mix_taken for r in mixing.mix(blank).collect()] == [0, 0]
    assert mixing.draw(blank).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_apportionment_is_that_of_highest_quotients(spark, seed):
    rng = random.Random(seed)
    rows, expected = [], {}
    for group in range(6):
        votes = [rng.choice([0.0, rng.random(), rng.random() * 50, 1.0]) for _ in range(rng.randint(1, 12))]
        seats = rng.randint(0, 60)
        heap = [(-v, i, 0) for i, v in enumerate(votes) if v > 0]
        heapq.heapify(heap)
        quota = [0] * len(votes)
        for _ in range(seats if heap else 0):
            _, i, k = heapq.heappop(heap)
            quota[i] += 1
            heapq.heappush(heap, (-votes[i] / (2 * k + 3), i, k + 1))
        for i, v in enumerate(votes):
            rows.append((group, i, v, seats))
            expected[group, i] = quota[i]
    df = spark.createDataFrame(rows, "all int, party int, votes double, seats long")
    found = mixing.apportion(df, "all").collect()
    assert {(r["all"], r.party): r.quota for r in found} == expected


def parts_of(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def rule_of(host, path):
    fits = []
    for verdict, text in URL_RULES:
        name, rest = text[: text.index("/")], text[text.index("/") :]
        if (host == name or host.endswith("." + name)) and path.startswith(rest):
            fits.append((len(text), text, verdict))
    return max(fits)[1:] if fits else (None, None)


ODD_URLS = [
    None, "", "no scheme", "http://", "HTTP://A.NET/x", "http://a.net", "http://a.net?x=/y", "http://anet/x", "http://net/", "http://É.NET/Ä",
    "http://b.example.net/en/1#t", "http://example.net/en", "http://x.example.com/de/9?u=://z/", "http://x.org/fr/", "http://xorg/fr/",
    "http://x.org/fr/1\nnew", "x://y://z/w", "http://h.com//a//b/../c/d/e/f/g/" + "z" * 5000,
]


def test_url_parts_and_rules(spark):
    rows = [(i, u) for i, u in enumerate(ODD_URLS)] + [(3, ODD_URLS[3])]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("x")).withColumn("template", F.lit(1))
    none = spark.createDataFrame([], "host string, path string, good int")
    found = {r.id: r for r in urls.judge(pages, none, URL_RULES).collect()}
    assert len(found) == len(ODD_URLS)
    for i, u in rows:
        host, path = parts_of(u)
        rule, verdict = rule_of(host, path)
        assert (found[i].host, found[i].path, found[i].rule) == (host, path, rule)
        assert found[i].verdict == (verdict or "allow")
    assert urls.judge(pages.where("false"), none).count() == 0


def test_bad_branch_is_told_from_its_siblings(spark):
    rng = random.Random(3)
    names = [*(f"topic{c}" for c in "abcdefghij"), "spam"]
    rows = [("a.com", f"/{d}/{rng.randrange(10**6)}", 0 if d == "spam" else 1) for d in names for _ in range(60)]
    rows += [("b.com", f"/x/{rng.randrange(10**6)}", rng.random() < 0.9) for _ in range(60)]
    labels = spark.createDataFrame([(h, p, int(g)) for h, p, g in rows], "host string, path string, good int")
    pages = spark.createDataFrame([(i, f"http://{h}{p}") for i, (h, p, _) in enumerate(rows)] + [(999, "http://a.com/spam/77.html")], "page_id long, url string")
    found = {r.id: r for r in urls.judge(pages, labels).collect()}
    assert all((found[i].verdict == "block") == ("/spam/" in p) for i, (_, p, _) in enumerate(rows))
    assert {found[i].template for i, (h, p, _) in enumerate(rows) if "/spam/" not in p} == {"/*/*", "/x/*"}
    assert found[0].template == found[70].template != found[605].template == found[999].template.replace(".html", "")


def templates(spark, rows):
    """Template and purity of every (path of a.com, pages, labelled, good), by path."""
    columns = "segments array<string>, n int, good int"
    data = [(p.split("/")[1:], n, g) for p, pages, bad, good in rows for n, g in ((pages, None), (bad, 0), (good, 1)) if n]
    pages = spark.createDataFrame(data, columns).select(F.lit("a.com").alias("host"), "segments", "good", F.explode(F.sequence(F.lit(1), "n")))
    leaves = urls.grow_templates(pages.drop("col"))
    judged = leaves.join(urls.judge_templates(leaves), ["host", "template"]).collect()
    return {"/" + "/".join(r.segments): (r.template, r.rejected) for r in judged}


def test_rare_bad_sections_of_a_hot_host_stand(spark):
    rows = [("/news/*", 80_000, 0, 3_000), ("/blog/*", 79_000, 0, 3_000), ("/spam/*", 800, 800, 0), ("/few/*", 5, 15, 0)]
    rows += [(f"/slug{i}/*", 2, int(i == 7), int(i != 7)) for i in range(200)]
    found = templates(spark, rows)
    assert found["/spam/*"] == ("/spam/*", True) and found["/few/*"] == ("/few/*", True)
    # One label of many branches is no evidence.
    assert not found["/slug7/*"][1] and found["/slug7/*"][0] == found["/slug8/*"][0]


def test_branches_that_differ_in_deep_segments(spark):
    rows = [("/en/*/*/*/spam/*", 50, 40, 0), ("/en/*/*/*/news/*", 50, 0, 40), ("/de/a/b/c/d/e/bad/*/x", 50, 40, 0), ("/de/a/b/c/d/e/ok/*/y", 50, 0, 40)]
    found = templates(spark, rows)
    assert {p: r for p, (_, r) in found.items()} == {p: bool(bad) for p, _, bad, _ in rows}
    assert "/spam" in found["/en/*/*/*/spam/*"][0] and "/bad" in found["/de/a/b/c/d/e/bad/*/x"][0]


def test_url_query_on_given_pages(spark, sf):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    found = QUERIES["op7_urls"](spark, sf).collect()
    assert len(found) == len(pages)
    for r in found:
        host, path = parts_of(pages[r.page_id])
        rule, verdict = rule_of(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict or r.verdict) == r.verdict
