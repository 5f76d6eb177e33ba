import random
import re

from kinframe.llm import url_templates as ut

RULES = {"net/": "block", "example.net/en/": "allow", "example.com/de/": "block", "org/fr/": "allow"}


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return "".join(c.lower() if c.isascii() else c for c in host), path


def rule(host, path):
    fits = [r for r in RULES if (host == r.split("/", 1)[0] or host.endswith("." + r.split("/", 1)[0]))
            and path.startswith("/" + r.split("/", 1)[1])]
    return max(fits, key=len, default=None)


def tree_verdicts(pages, labels, z=2.58, k=10.0):
    """Template and share of bad pages per page, level by level in plain Python."""
    shapes = {}
    for p, url in pages:
        host, path = split(url)
        parts = [x for x in path.split("/") if x]
        shape = ["{n}" if re.match(ut._NUMBER, x) else "{x}" if re.match(ut._HEX, x) else x for x in parts]
        shapes[p] = (host, tuple(shape))
    template = dict.fromkeys(shapes, "")
    for level in range(max(len(s) for _, s in shapes.values())):
        here = {p: (h, template[p], s[level]) for p, (h, s) in shapes.items() if len(s) > level}
        for h, parent in {(h, t) for h, t, _ in here.values()}:
            own = {}
            for p, (a, b, c) in here.items():
                if (a, b) == (h, parent):
                    own.setdefault(c, []).append(p)
            counts = {c: (len(x), sum(p in labels for p in x), sum(labels.get(p, 0) for p in x)) for c, x in own.items()}
            lab, bad = (sum(v[i] for v in counts.values()) for i in (1, 2))
            for c, x in own.items():
                _, l, b = counts[c]
                error = (bad / lab * (1 - bad / lab) * (1 / l + 1 / (lab - l))) ** 0.5 if 0 < l < lab else 0
                differs = error > 0 and abs(b / l - (bad - b) / (lab - l)) > z * error
                keep = c in ("{n}", "{x}") or len(own) == 1 or differs
                for p in x:
                    template[p] = parent + "/" + (c if keep else "*")
    base = sum(labels.values()) / max(1, sum(p in shapes for p in labels)) if labels else 0.0
    out = {}
    for p, (h, _) in shapes.items():
        of = lambda f: [labels[q] for q in shapes if f(q) and q in labels]
        host, own = of(lambda q: shapes[q][0] == h), of(lambda q: shapes[q][0] == h and template[q] == template[p])
        share = (sum(host) + k * base) / (len(host) + k)
        out[p] = (template[p], "block" if (sum(own) + k * share) / (len(own) + k) > 0.5 else "allow")
    return out


def test_against_plain_python(session):
    rng = random.Random(6)
    urls = [None, "", "no url", "http://", "://Host.org", "http://A.example.NET/en/x", "http://example.net?x=/en/", "ftp://net/", "http://xnet/",
            "http://a.net", "http://b.example.com/de/", "http://example.com/de", "http://q.org/fr/1#f", "https://u@w.org//fr///1/2"]
    urls += [f"http://hot.example.com/{rng.choice(['en', 'fr', 'spam', 'shop'])}/{k}" for k in range(400)]
    urls += [f"http://hot.example.com/tag/word{k}/x" for k in range(60)]
    urls += [f"http://s{k % 5}.example.org/en/{k}.html?p=1" for k in range(100)]
    urls += ["http://deep.org/" + "a/" * 20 + str(k % 2) for k in range(4)] + ["http://hex.org/p/0123456789abcdef0123"]
    urls += ["http://deep.org/" + "a/" * (k % 5) + rng.choice(["b", "c/d", "c/d/" + "e/" * 30]) for k in range(60)]
    urls += [f"http://wide.org/{'/'.join(rng.choice('uvw') for _ in range(rng.randrange(0, 7)))}" for _ in range(150)]
    urls += [f"http://grow.org/c{k % 40}/{'bad' if k % 40 == 7 else 'ok'}/{k}" for k in range(400)] + ["http://long.org/" + "seg/" * 3000 + "end"]
    pages = list(enumerate(urls))
    labels = {p: int("/spam/" in (u or "") or "/bad/" in (u or "") or "/u/v" in (u or "") or rng.random() < 0.1) for p, u in pages if rng.random() < 0.6}
    table = session.createDataFrame([(p, u, "h", "t") for p, u in pages], "page_id long, url string, host string, template string")
    marks = session.createDataFrame([(p, b) for p, b in labels.items()], "page_id long, bad int")
    got = {r.page_id: r for r in ut.judge(table, marks).collect()}
    want = tree_verdicts(pages, labels)
    assert len(got) == len(pages)
    for p, url in pages:
        host, path = split(url)
        r = got[p]
        assert (r.host, r.path, r.rule) == (host, path, rule(host, path)), url
        assert r.template == want[p][0], url
        assert r.verdict == (RULES[r.rule] if r.rule else want[p][1]), url
    assert {got[p].verdict for p, u in pages if u and "hot" in u and "/spam/" in u} == {"block"}
    assert {got[p].verdict for p, u in pages if u and "hot" in u and "/shop/" in u} == {"allow"}


def test_empty_tables_and_repeats(session):
    marks = session.createDataFrame([], "page_id long, bad int")
    assert ut.judge(session.createDataFrame([], "page_id long, url string"), marks).collect() == []
    rows = [(1, "http://a.org/x")] * 3 + [(None, None)]
    got = ut.judge(session.createDataFrame(rows, "page_id long, url string"), marks).collect()
    assert len(got) == 4 and {r.verdict for r in got} == {"allow"}


def test_a_rare_branch_that_differs_is_kept(session):
    """All pages of one of 30 children, with 0.7 % of the host's pages, are bad."""
    urls = [f"http://many.org/c{k % 29}/{k}" for k in range(2900)] + [f"http://many.org/evil/{k}" for k in range(20)]
    pages = list(enumerate(urls))
    table = session.createDataFrame(pages, "page_id long, url string")
    marks = session.createDataFrame([(p, int("/evil/" in u or p % 20 == 0)) for p, u in pages], "page_id long, bad int")
    got = {r.page_id: r for r in ut.judge(table, marks).collect()}
    assert len(got) == len(pages)
    assert {(got[p].template, got[p].verdict) for p, u in pages if "/evil/" in u} == {("/evil/{n}", "block")}
    assert {(got[p].template, got[p].verdict) for p, u in pages if "/evil/" not in u} == {("/*/{n}", "allow")}


def test_deep_branches_are_told_apart(session):
    """Pages below 13 shared and differing segments."""
    deep = "/".join(f"s{k}" for k in range(11))
    urls = [f"http://d.org/{deep}/x/{'bad' if k % 2 else 'good'}/{k}" for k in range(200)]
    pages = list(enumerate(urls))
    marks = session.createDataFrame([(p, p % 2) for p, _ in pages], "page_id long, bad int")
    got = {r.page_id: r.verdict for r in ut.judge(session.createDataFrame(pages, "page_id long, url string"), marks).collect()}
    assert got == {p: "block" if p % 2 else "allow" for p, _ in pages}
