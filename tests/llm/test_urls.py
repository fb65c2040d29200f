from skylattice.llm import urls

SCHEMA = "page_id bigint, url string, host string, score string, extra int"
CASES = {
    "http://a.org/x": ("a.org", "/x", "org/", "allow"), "http://example.org/es/1": ("example.org", "/es/1", "example.org/es/", "block"),
    "https://WWW.Example.ORG/en/17?q=/x#y": ("www.example.org", "/en/17", "example.org/en/1", "block"),
    "http://notexample.org/es/1": ("notexample.org", "/es/1", "org/", "allow"), "http://x.com/fr/": ("x.com", "/fr/", "com/fr/", "allow"),
    "http://com/de/1": ("com", "/de/1", "com/de/", "block"), "http://x.org": ("x.org", "", None, None), "http://x.org?a=/b": ("x.org", "", None, None),
    "http://x.org#/b": ("x.org", "", None, None), "no scheme/org/": ("", "", None, None), None: ("", "", None, None), "": ("", "", None, None),
    "://y.org/a://b": ("y.org", "/a://b", "org/", "allow"), "http://x.net/org/": ("x.net", "/org/", None, None), "http:///path": ("", "/path", None, None),
    "http://ÄB.com/de/ü": ("Äb.com", "/de/ü", "com/de/", "block"), "a\nb://h\nx.org/p\nq?z": ("h\nx.org", "/p\nq", "org/", "allow"),
}


def test_rules_and_parts(spark):
    model = urls.fit(urls.LABELLED)
    data = list(enumerate(CASES))
    pages = spark.createDataFrame([(i, url, "old", "old", 1) for i, url in data + data[:2]], SCHEMA)
    found = urls.judge(pages, urls.RULES, model)
    assert "extra" in found.columns and found.count() == len(data) + 2
    for row in found.collect():
        url = data[row.page_id][1]
        host, path, rule, verdict = CASES[url]
        assert (row.host, row.path, row.rule) == (host, path, rule), url
        assert urls.split_url(url) == (host, path)
        alone = model.score([host.replace("\n", " ")], [path])[0]
        assert row.score == alone and row.verdict == (verdict or ("block" if alone >= 0.5 else "allow"))
    assert urls.judge(pages.limit(0), urls.RULES, model).count() == 0


def test_held_out_accuracy():
    right = 0
    for fold in range(4):
        model = urls.fit([pair for i, pair in enumerate(urls.LABELLED) if i % 4 != fold])
        for url, label in urls.LABELLED[fold::4]:
            host, path = urls.split_url(url)
            right += (model.score([host], [path])[0] >= 0.5) == bool(label)
    assert right / len(urls.LABELLED) >= 0.6
    model = urls.fit(urls.LABELLED)
    assert model.score(["m.ads-track.example.com"], ["/en/1"])[0] > 0.5 > model.score(["blog.example.com"], ["/en/stories"])[0]
