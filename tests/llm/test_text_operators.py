"""Secrets, quality rules, PII and URLs against plain Python."""

import datetime
import hashlib
import re
from collections import Counter

import pytest
from conftest import prose

from readloom.llm import pii, quality, secrets, urls

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def base_spans(t):
    t = t or ""
    out = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    out += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 18]
    out += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 16]
    return sorted(out)


SECRETS = [
    "password = 'hunter2hunter2' and TOKEN:abcdefghijkl é api_key=\"0123456789abcdef0123\"",
    "secret=token:abcdefghijklmno", "é AKIA" + "A1" * 8 + " AKIAAKIA" + "B" * 14, "AKIAshort", "deadbeefdeadbeef", "xdeadbeefdeadbeefx secret:aaaaaaaaaaaa", "passwd" + " " * 30 + "=" + "z" * 12, "token==abcdefghijklmnop", "", None,
]


def test_secret_spans(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(SECRETS * 2)], "doc_id int, text string")
    got = {r.doc_id: r for r in secrets.digest(secrets.findings(docs, secrets.scan(docs))).collect()}
    for i, t in enumerate(SECRETS * 2):
        want = base_spans(t)
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == o for _, o, _ in want) for k in range(3)]
        assert got[i].base_sha256 == hashlib.sha256(",".join(s for _, _, s in want).encode()).hexdigest()
        assert got[i].spans == ",".join(s for _, _, s in want)


def test_the_ledger_scans_only_what_it_lacks(spark):
    history = spark.createDataFrame([("a", SECRETS[0]), ("a", SECRETS[1]), ("b", SECRETS[0]), ("c", "gh" + "p_" + "x" * 36)], "path string, text string")
    ledger = secrets.scan(history)
    assert ledger.count() == 3  # a blob of two paths once
    assert secrets.scan(history, ledger).count() == 0
    more = history.union(spark.createDataFrame([("d", "new text")], history.schema))
    assert secrets.scan(more, ledger).count() == 1
    raised = tuple(r if r.kind != "hex" else secrets.Rule("hex", 2, "[0-9a-f]{8,}") for r in secrets.RULES)
    again = secrets.scan(history, ledger, raised)
    assert {x.kind for r in again.collect() for x in r.results} == {"hex"}
    found = secrets.findings(history, ledger.union(again), raised).collect()
    versions = {(x.kind, x.version) for r in found for x in r.results}
    assert ("hex", 2) in versions and ("hex", 1) not in versions
    assert [len(r.results) for r in found if r.path == "b"] == [len(r.results) for r in found if r.path == "a" and r.text == SECRETS[0]]


def test_a_stored_ledger_grows_by_what_is_new(spark, tmp_path):
    path = str(tmp_path / "ledger")
    history = spark.createDataFrame([(i, SECRETS[i % 8] or "") for i in range(40)], "doc_id int, text string")
    distinct = len({SECRETS[i % 8] for i in range(40)})
    assert secrets.update(history, path) == distinct and secrets.update(history, path) == 0
    assert secrets.update(history.union(spark.createDataFrame([(99, "passwd: abcdefghijklmn")], history.schema)), path) == 1
    raised = tuple(r if r.kind != "hex" else secrets.Rule("hex", 2, "[0-9a-f]{8,}") for r in secrets.RULES)
    assert secrets.update(history, path, raised) == distinct and secrets.update(history, path, raised) == 0
    ledger = secrets.load(spark, path)
    rescans = [x for r in ledger.collect() if len(r.results) == 1 for x in r.results]
    assert len(rescans) == distinct and {(x.kind, x.version) for x in rescans} == {("hex", 2)}  # only that rule was run again
    for rules in (secrets.RULES, raised):
        alone = secrets.findings(history, secrets.scan(history, rules=rules), rules).select("doc_id", "results").collect()
        kept = secrets.findings(history, ledger, rules).select("doc_id", "results").collect()
        order = lambda rows: {r.doc_id: sorted(map(str, r.results)) for r in rows}
        assert order(alone) == order(kept)


def brute_quality(t):
    t = t or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(ws[i : i + 3]) for i in range(len(ws) - 2)]
    n = Counter(grams)
    repeated = {k for i, g in enumerate(grams) if n[g] > 1 for k in range(i, i + 3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    bad = len(ws) < 50 or 100 * len(repeated) > 50 * len(ws)
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeated), bad)


def test_quality_counts(spark, rng):
    texts = [prose(rng, rng.choice([0, 1, 2, 3, 4, 60, 200]), rng.choice([3, 8, 300])) for _ in range(60)]
    texts = [t.replace(" w1 ", "\n\n") if i % 3 else t + "\n" + t + "\r\n# é | x\n \n" for i, t in enumerate(texts)] + [None, "a a a a", "a b a b a b"]
    rows = quality.digest(quality.measure(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))).collect()
    for r in rows:
        assert tuple(r)[1:7] == brute_quality(texts[r.doc_id]), texts[r.doc_id]
        assert not (r.base_failed and r.kept)


def test_lines_go_before_documents(spark, rng):
    body = ". ".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(9)) for _ in range(12)) + "."
    docs = [(1, f"Home | News | Sport | About | Shop\n{body}\nAll rights reserved.\n{body[:0]}"), (2, "\n".join(["# % # %%% || ###"] * 9) + "\n" + body[:200]), (3, body)]
    out = {r.doc_id: r.text for r in quality.clean(spark.createDataFrame(docs, "doc_id int, text string")).collect()}
    assert out == {1: body, 3: body}


LINES = {
    "A line of prose.": False, "Is it? (yes)": False, "«Dit-il.»  \r": False, "他说。": False, "A heading without a mark": True, "of of of of": True, "Home | News.": True, "Home.|": True,
    "a b c d e f | g h i j k l.": False, "x### y%%% z.": True, "Released under the MIT License.": True, "Licensed under CC BY-NC 4.0.": True, "Distributed under the terms of a free licence.": True,
    "ALL RIGHTS RESERVED.": True, "© 2024 Someone.": True, "Copyright (c) 1999 Someone.": True, "They were under a license.": False, "Please click here.": True, "We talk of cookies.": False,
}


def test_line_rules(spark):
    df = spark.createDataFrame([(x,) for x in LINES], "line string")
    got = {r.line: r.fails for r in df.select("line", quality.line_fails(df.line).alias("fails")).collect()}
    assert got == LINES
    none = df.select(quality.line_fails(df.line, ()).alias("fails"), "line").filter("line = 'Please click here.'").first()
    assert not none.fails


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


KEY = "a key"
PII = "mail jo.doe91@mail7.example.com ip 12.197.240.125. card 4418452524842581, 4418-4525-2484-2581 bad 4418452524842582 phone +1 (784) 555-8120 ssn 123-45-6789 on 1999-12-31 not 2024-02-31 é 300.1.1.1 DE89370400440532013000."


def test_pseudonyms_keep_format_and_link(spark):
    docs = spark.createDataFrame([(1, PII), (2, "again 12.197.240.125 and jo.doe91@mail7.example.com"), (3, "clean text"), (4, None)], "doc_id int, text string")
    rows = {r.doc_id: r for r in pii.find(docs, KEY).collect()}
    new = {PII[x.start : x.end]: x.new for x in rows[1].pii}
    assert Counter(x.kind for x in rows[1].pii) == {"email": 1, "ip": 1, "card": 2, "phone": 1, "ssn": 1, "date": 1, "iban": 1}
    shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", s)))
    for old, repl in new.items():
        assert old != repl
        if "." not in old or "@" in old:
            assert shape(old) == shape(repl)
    card = re.sub("[^0-9]", "", new["4418452524842581"])
    assert luhn(card) and re.sub("[^0-9]", "", new["4418-4525-2484-2581"]) == card
    assert all(0 <= int(x) < 256 for x in new["12.197.240.125"].split("."))
    iban = new["DE89370400440532013000"]
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert rows[2].new_text == f"again {new['12.197.240.125']} and {new['jo.doe91@mail7.example.com']}"
    assert rows[3].new_text == "clean text" and rows[4].new_text is None
    whole = PII
    for x in reversed(rows[1].pii):
        whole = whole[: x.start] + x.new + whole[x.end :]
    assert rows[1].new_text == whole and "4418452524842582" in whole and "2024-02-31" in whole
    other = {r.doc_id: r for r in pii.find(docs, "another key").collect()}
    assert other[1].new_text != rows[1].new_text


def test_pseudonyms_are_permutations(spark):
    ssns = [f"{a:03d}-{g:02d}-{s:04d}" for a in (1, 665, 667, 899) for g in (1, 50, 99) for s in range(1, 40)]
    ips = [f"10.0.{i}.{j}" for i in range(12) for j in range(12)]
    days = [f"20{y:02d}-0{m}-1{d}" for y in range(10) for m in range(1, 9) for d in range(3)]
    for values in (ssns, ips, days):
        docs = spark.createDataFrame([(0, v) for v in values], "doc_id int, text string")
        got = [r.text for r in pii.pseudonymise(docs, KEY).collect()]
        assert len(set(got)) == len(values) and {len(x) for x in got} <= {len(x) for x in values} | set(range(7, 16))


def test_phones_of_any_area_are_found_and_link(spark):
    old = [f"({a:03d}) {e:03d}-{x:04d}" for a in (0, 17, 136, 199, 200, 999) for e in (0, 199, 200, 555, 999) for x in (0, 7713, 9999)]
    docs = spark.createDataFrame([(i, f"call {p}.") for i, p in enumerate(old)] + [(1000, "+1 017-555-7713 and +1 017 555 7713"), (1001, "017 555 7713"), (1002, "212 555 7713")], "doc_id int, text string")
    rows = {r.doc_id: r for r in pii.find(docs, KEY).collect()}
    new = [rows[i].pii[0].new for i in range(len(old))]
    assert all(re.fullmatch(r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}", x) for x in new) and len(set(new)) == len(old)
    assert [p[1] >= "2" and p[6] >= "2" for p in new] == [p[1] >= "2" and p[6] >= "2" for p in old]
    digits = lambda x: re.sub("[^0-9]", "", x)
    assert [digits(x.new) for x in rows[1000].pii] == ["1" + digits(new[old.index("(017) 555-7713")])] * 2
    assert not rows[1001].pii and rows[1001].new_text == "017 555 7713"
    assert re.fullmatch(r"[2-9][0-9]{2} [2-9][0-9]{2} [0-9]{4}", rows[1002].new_text)


def keyed(key, tag, turn, value, modulus):
    return int(hashlib.sha256(f"{key}|{tag}|{turn}|{value}".encode()).hexdigest()[:15], 16) % modulus


def plain_feistel(left, right, a, b, key, tag):
    for t in range(pii.ROUNDS):
        if t % 2 == 0:
            left = (left + keyed(key, tag, t, right, a)) % a
        else:
            right = (right + keyed(key, tag, t, left, b)) % b
    return left, right


def plain_digits(d, key, tag):
    a, b = len(d) // 2, len(d) - len(d) // 2
    x, y = plain_feistel(int(d[:a]), int(d[a:]), 10**a, 10**b, key, f"{tag}{len(d)}")
    return f"{x:0{a}d}{y:0{b}d}"


def plain_letters(value, key, tag):
    def shift(text, other, turn):
        s = hashlib.sha512(f"{key}|{tag}|{turn}|{other}".encode()).hexdigest()
        out = ""
        for i, c in enumerate(text):
            by = int(s[i * 2 % 126 : i * 2 % 126 + 3], 16) + i // 63
            first, size = (97, 26) if "a" <= c <= "z" else (65, 26) if "A" <= c <= "Z" else (48, 10) if c.isdigit() else (ord(c), 1)
            out += chr((ord(c) - first + by) % size + first)
        return out

    left, right = value[: len(value) // 2], value[len(value) // 2 :]
    for t in range(pii.ROUNDS):
        if t % 2 == 0:
            left = shift(left, right, t)
        else:
            right = shift(right, left, t)
    return left + right


def refilled(value, new):
    it = iter(new)
    return "".join(next(it) if c.isdigit() else c for c in value)


def plain(kind, v, key):
    """The pseudonym of a valid value."""
    d = re.sub("[^0-9]", "", v)
    if kind == "ip":
        p = [int(x) for x in v.split(".")]
        x, y = plain_feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, key, "ip")
        return ".".join(map(str, (x // 256, x % 256, y // 256, y % 256)))
    if kind == "date":
        form = "%d.%m.%Y" if v[2] == "." else f"%Y{v[4]}%m{v[4]}%d"
        day = (datetime.datetime.strptime(v, form) - datetime.datetime(1900, 1, 1)).days
        x, y = plain_feistel(day // 365, day % 365, 200, 365, key, "date")
        return (datetime.datetime(1900, 1, 1) + datetime.timedelta(x * 365 + y)).strftime(form)
    if kind == "ssn":
        area, group, serial = (int(x) for x in v.split("-"))
        place = area - 2 if area > 666 else area - 1
        x, y = plain_feistel(place * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn")
        p = x // 99
        return f"{p + 2 if p >= 665 else p + 1:03d}-{x % 99 + 1:02d}-{y + 1:04d}"
    if kind == "card":
        body = plain_digits(d[:-1], key, "card")
        return refilled(v, body + next(c for c in "0123456789" if luhn(body + c)))
    if kind == "iban":
        body = plain_letters(v[4:], key, "iban")
        return f"{v[:2]}{98 - int(''.join(str(int(c, 36)) for c in body + v[:2] + '00')) % 97:02d}{body}"
    if kind == "email":
        name, last = v.rsplit(".", 1)
        return plain_letters(name, key, "email") + "." + last
    if v.startswith("+") and not re.match(r"\+1[ .-]?[0-9]{3}[ .-]|\+1[ .-]?\(", v):
        code = re.match(r"\+[0-9]+", v)[0]
        rest = v[len(code) :]
        return code + refilled(rest, plain_digits(re.sub("[^0-9]", "", rest), key, "phone abroad"))
    ten, lead = d[-10:], d[:-10]
    a, e, line = int(ten[:3]), int(ten[3:6]), int(ten[6:])
    if a >= 200 and e >= 200:
        x, y = plain_feistel((a - 200) * 800 + e - 200, line, 640_000, 10_000, key, "phone")
        a, e = x // 800 + 200, x % 800 + 200
    else:
        x, y = plain_feistel(a * 1000 + e if a < 200 else 200_000 + (a - 200) * 200 + e, line, 360_000, 10_000, key, "phone other")
        a, e = (x // 1000, x % 1000) if x < 200_000 else ((x - 200_000) // 200 + 200, (x - 200_000) % 200)
    return refilled(v, f"{lead}{a:03d}{e:03d}{y:04d}")


def some_values(rng):
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    for _ in range(60):
        body = n(rng.choice([12, 14, 15, 18]))
        card = body + next(c for c in "0123456789" if luhn(body + c))
        yield "card", card
        yield "card", " ".join(card[i : i + 4] for i in range(0, len(card), 4))
        yield "ip", ".".join(str(rng.randrange(256)) for _ in range(4))
        day = datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(73_000))
        yield "date", day.strftime(rng.choice(["%Y-%m-%d", "%Y/%m/%d", "%d.%m.%Y"]))
        yield "ssn", f"{rng.choice([1, 665, 667, 899, rng.randrange(1, 666)]):03d}-{rng.randrange(1, 100):02d}-{rng.randrange(1, 10_000):04d}"
        account = rng.choice(["", "AB"]) + n(16)
        country = rng.choice(["DE", "GB", "FR"])
        yield "iban", f"{country}{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}{account}"
        yield "email", f"{rng.choice(['jo', 'A.B-c', 'x' * 70])}{n(2)}@{rng.choice(['m', 'mail-7.example'])}.org"
        yield "phone", f"({n(3)}) {n(3)}-{n(4)}"
        yield "phone", f"+1 {n(3)}.{n(3)}.{n(4)}"
        yield "phone", f"+{rng.choice(['44', '49', '351', '86'])} {n(rng.choice([2, 3]))} {n(4)} {n(3)}"


def test_all_kinds_against_plain_python(spark, rng):
    values = list(dict.fromkeys(some_values(rng)))
    docs = spark.createDataFrame([(i, f"x {v} y") for i, (_, v) in enumerate(values)], "doc_id int, text string")
    rows = {r.doc_id: r for r in pii.find(docs, KEY).collect()}
    for i, (kind, v) in enumerate(values):
        assert [(x.kind, x.start, x.end, x.new) for x in rows[i].pii] == [(kind, 2, 2 + len(v), plain(kind, v, KEY))], (kind, v)
        assert rows[i].new_text == f"x {plain(kind, v, KEY)} y"
    by_kind = {k: [plain(k, v, KEY) for kind, v in values if kind == k] for k in pii.KINDS}
    assert all(len(set(x)) == len(x) for x in by_kind.values())


def test_a_day_is_linked_over_formats(spark):
    docs = spark.createDataFrame([(1, "1999-12-31 and 1999/12/31 and 31.12.1999, not 31.02.1999 1.2.3.31.12.1999")], "doc_id int, text string")
    new = [x.new for x in pii.find(docs, KEY).first().pii]
    y, m, d = new[0].split("-")
    assert new == [f"{y}-{m}-{d}", f"{y}/{m}/{d}", f"{d}.{m}.{y}"]


def test_every_pseudonym_of_a_small_domain_is_another(spark):
    a, b = 7, 11
    pairs = spark.range(a * b).selectExpr("id div 11 l", "id % 11 r")
    got = {(r.x.l, r.x.r) for r in pairs.select(pii.feistel(pairs.l, pairs.r, a, b, KEY, "t").alias("x")).collect()}
    assert got == {(i, j) for i in range(a) for j in range(b)}


URLS = ["https://WWW.Example.com/en/1?q#f", "http://a.example.com/en/", "ftp://example.net/es/x", "x://b.net/fr/", "x://net/de/", "no scheme", None, "://host", "http://com", "http://com/", "http://a.b.com/q", "http://notcom/en/", "http://h://p/x?y", "HTTP://É.ORG/a b"]


def brute_url(u):
    if u is None or "://" not in u:
        return "", ""
    rest = u.split("://", 1)[1]
    h = re.split(r"[/?#]", rest, maxsplit=1)[0]
    p = re.split(r"[?#]", rest[len(h) :], maxsplit=1)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), h), p


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id int, url string")
    rows = {r.page_id: r for r in urls.judge(pages, spark.createDataFrame([], "page_id int, bad int")).collect()}
    for i, u in enumerate(URLS):
        h, p = brute_url(u)
        fits = [r for r in urls.RULES if (h == r.host or h.endswith("." + r.host)) and p.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        assert (rows[i].host, rows[i].path, rows[i].rule) == (h, p, best and best.name)
        assert rows[i].verdict == (best.verdict if best else "allow")


def test_reputation_shrinks_by_level(spark, rng):
    pages, labels, i = [], [], 0
    for domain, rate in (("good.org", 0.02), ("bad.org", 0.95)):
        for h in range(6):
            for _ in range(40):
                pages.append((i, f"http://h{h}.{domain}/x"))
                labels.append((i, int(rng.random() < rate)))
                i += 1
    pages += [(i, "http://new.good.org/"), (i + 1, "http://new.bad.org/"), (i + 2, "http://unseen.zz/")]
    scored = {r.page_id: r for r in urls.judge(spark.createDataFrame(pages, "page_id int, url string"), spark.createDataFrame(labels, "page_id int, bad int")).collect()}
    assert scored[0].verdict == "allow" and scored[i - 1].verdict == "block"
    assert scored[i].bad_rate < 0.2 < 0.7 < scored[i + 1].bad_rate
    assert abs(scored[i + 2].bad_rate - sum(b for _, b in labels) / len(labels)) < 0.01


def test_registered_domains(spark):
    cases = {
        "a.b.example.co.uk": ("example.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "u:p@h.example.com:8080": ("example.com", "com"), "10.0.0.1": ("10.0.0.1", ""), "10.0.0.1:80": ("10.0.0.1", ""),
        "[::1]:80": ("[::1]", ""), "host": ("host", "host"), "": ("", ""), "www.example.org": ("example.org", "org"),
    }
    df = spark.createDataFrame([(h,) for h in cases], "host string")
    got = {r.host: (r.d, r.s) for r in df.select("host", urls.registered_domain(df.host).alias("d"), urls.suffix(df.host).alias("s")).collect()}
    assert got == cases
    mine = df.filter("host = 'www.example.org'").select(urls.registered_domain(df.host, ("example.org",)).alias("d")).first()
    assert mine.d == "www.example.org"


def test_many_rules_are_joined(spark, rng):
    hosts = ["com", "a.com", "b.a.com", "net", "x.net", "co.uk"]
    names = dict.fromkeys((rng.choice(hosts), "/" + "".join(rng.choice("ab/") for _ in range(rng.randrange(4)))) for _ in range(120))
    rules = [urls.UrlRule(rng.choice(["allow", "block"]), h, p) for h, p in names]
    pages = [(i, f"http://{rng.choice(['', 'w.', 'b.a.'])}{rng.choice(hosts)}/{''.join(rng.choice('ab/') for _ in range(rng.randrange(5)))}") for i in range(400)] + [(900, None), (901, "http://com")]
    df, labels = spark.createDataFrame(pages, "page_id int, url string"), spark.createDataFrame([], "page_id int, bad int")
    table = spark.createDataFrame([(r.verdict, r.host, r.path) for r in rules], "verdict string, host string, path string")
    for given in (table, tuple(rules)):
        got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(df, labels, given).collect()}
        for i, u in pages:
            h, p = brute_url(u)
            fits = [r for r in rules if (h == r.host or h.endswith("." + r.host)) and p.startswith(r.path)]
            best = min(fits, key=lambda r: (-len(r.name), -len(r.host), r.name), default=None)
            assert got[i] == ((best.name, best.verdict) if best else (None, "allow"))
    assert urls.judge(df, labels, ()).filter("rule is not null").count() == 0


@pytest.mark.parametrize("which", ["odd", "none"])
def test_odd_rows(spark, which, request):
    df = request.getfixturevalue(which)
    n = df.count()
    found = secrets.digest(secrets.findings(df, secrets.scan(df)))
    assert found.count() == n
    assert quality.digest(quality.measure(df)).count() == n
    clash = df.withColumn("n_words", df.doc_id).withColumn("pii", df.text).withColumn("clean_text", df.text)
    assert quality.clean(clash).columns == clash.columns and quality.clean(clash).count() <= n
    out = pii.pseudonymise(clash, KEY)
    assert out.columns == clash.columns and out.count() == n
    pages = df.selectExpr("doc_id page_id", "text url", "score", "results host")
    assert urls.judge(pages, df.selectExpr("doc_id page_id", "1 bad")).count() == n
