import random
import re

from massloom.llm import op05_rules as r5
from massloom.llm import op06_urls as u6


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    under = {j for s in at.values() if len(s) > 1 for i in s for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(under)


def test_statistics_match_plain_python(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t ", "a", "é 漢 😀 x", "|#*$%&<>|", "l\nl\n l\nl\n\n\n", "a b c d e f g h " * 3, "x " * 40, "\x0b\x0c\r a\r\nb"]
    for _ in range(40):
        w = [rng.choice(["a", "b", "é", "|x", "LONG"]) for _ in range(rng.randrange(0, 60))]
        texts.append("".join(x + rng.choice([" ", "\n", "  ", "\t"]) for x in w))
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, words string, n_words int")
    got = {r.doc_id: tuple(r[c] for c in r5.BASE) for r in r5.text_statistics(df).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


def test_rules_are_learned_and_applied(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        junk = i % 4 == 0
        w = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)]
        rows.append((i, " ".join(x + ("###" if junk else "") for x in w)))
        labels.append((i, 0 if junk else 1, None))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (None, 1, None), (9999, 0, None), (3, None, 1)], "doc_id long, quality int, toxic int")
    out, rules = r5.judge(docs, marks)
    got = {r.doc_id: r.kept for r in out.collect()}
    assert rules and all(got[i] == bool(i % 4) for i in range(400))
    none, rules = r5.judge(docs, marks.limit(0))
    assert not rules and none.filter("kept").count() == 400
    assert r5.judge(docs.limit(0), marks)[0].count() == 0


def test_urls_match_plain_python(spark):
    rng = random.Random(6)
    hosts = ["example.com", "www.example.com", "a.www.example.com", "WWW.Example.COM", "example.net", "xexample.com", "com", "spam-farm.example.org", "m.spam-farm.example.org", "notspam-farm.example.org", "", "net"]
    urls = [None, "", "no scheme", "://", "http://", "http://x.org?q=/en/"] + [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en', '/en/1', '/es/2?x=#y', '/fr/3#/en/', '?a=://b/en/', '#t', '/EN/1'])}" for _ in range(300)]
    listed = {f"{a}.{b}" for a in u6.LISTED_LABELS for b in u6.LISTED_DOMAINS}

    def want(u):
        host = path = ""
        if u and "://" in u:
            rest = re.split(r"[?#]", u.split("://", 1)[1])[0]
            host, slash, path = rest.partition("/")
            host, path = re.sub("[A-Z]", lambda m: m.group().lower(), host), slash + path
        fit = [(h + p, v) for h, p, v in u6.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fit, key=lambda x: len(x[0])) if fit else (None, None)
        parts = host.split(".")
        known = any(".".join(parts[i:]) in listed for i in range(len(parts)))
        return host, path, rule, verdict or ("block" if known else "allow")

    df = spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in u6.judge_urls(df, u6.default_list(spark)).collect()}
    assert got == {i: want(u) for i, u in enumerate(urls)}
    assert u6.judge_urls(df.limit(0), u6.default_list(spark)).count() == 0


def test_cascade_is_exact_over_its_universe(spark):
    keys = [f"k{i}" for i in range(3000)]
    universe = spark.createDataFrame([(k,) for k in keys], "key string")
    listed = spark.createDataFrame([(k,) for k in keys[::7]] + [("elsewhere",), (None,)], "key string")
    cascade = u6.build_cascade(universe, listed.dropna())
    assert len(cascade.levels) > 1
    got = {r.key for r in universe.filter(cascade.holds(u6.F.col("key"))).collect()}
    assert got == set(keys[::7])
    assert universe.filter(u6.build_cascade(universe, listed.limit(0)).holds(u6.F.col("key"))).count() == 0
