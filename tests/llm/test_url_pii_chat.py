import datetime
import hashlib
import re

import pytest
import regex
from pyspark.sql import functions as F

from overstrata.llm import chat, pii, urlfilter

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("org", "", "block")]
URLS = [
    (1, "https://A.Example.COM/en/71?x#y", "a.example.com", "/en/71", "example.com/en/7", "allow"),
    (2, "http://example.com/en/8", "example.com", "/en/8", "com/en/", "block"),
    (3, "http://notexample.com/en/7", "notexample.com", "/en/7", "com/en/", "block"),
    (4, "http://com/en/", "com", "/en/", "com/en/", "block"),
    (5, "http://x.org", "x.org", "", "org", "block"),
    (6, None, "", "", None, "allow"),
    (7, "no scheme.com/en/", "", "", None, "allow"),
    (8, "http://?q=http://a.com/en/", "", "", None, "allow"),
    (9, "http://a.com?/en/", "a.com", "", None, "allow"),
    (5, "http://x.org", "x.org", "", "org", "block"),
    (None, "x://b.com/en/1\n2", "b.com", "/en/1\n2", "com/en/", "block"),
]


@pytest.mark.parametrize("blocks", [1 << 20, 1])
def test_urls(spark, monkeypatch, blocks):
    monkeypatch.setattr(urlfilter, "MOST_BLOCKS", blocks)
    pages = spark.createDataFrame([(p, u, "h", "k") for p, u, *_ in URLS], "page_id long, url string, host string, key string")
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    got = sorted(map(str, [(r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in urlfilter.judge(pages, rules).collect()]))
    assert got == sorted(map(str, URLS))
    assert urlfilter.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in urlfilter.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_many_rules(spark):
    """The filter passes all listed keys and few others; pages without a hit meet no exchange."""
    rules = spark.createDataFrame([(f"h{i}.com", f"/p{i}", "block") for i in range(3000)], "host string, path string, verdict string")
    keys = rules.selectExpr("concat(host, '\\n', path) as key")
    seen = spark.range(20_000).selectExpr("concat('h', id, '.com\\n/p', id) as key", "id").withColumn("words", urlfilter.bloom(keys, 512))
    seen = {r.id for r in seen.filter(f"(words[{urlfilter._block('key', 512)}] & {urlfilter._bits('key')}) = {urlfilter._bits('key')}").collect()}
    assert seen >= set(range(3000)) and len(seen) < 3000 + 0.1 * 17_000
    pages = spark.createDataFrame([(i, f"http://www.h{i}.com/p{i if i % 2 else 'x'}/z") for i in range(6000)], "page_id long, url string")
    got = {r.page_id for r in urlfilter.judge(pages, rules).filter("verdict = 'block'").collect()}
    assert got == {i for i in range(3000) if i % 2}


def luhn(s):
    return sum((2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) if j % 2 else int(c) for j, c in enumerate(reversed(s))) % 10 == 0


def permuted(key, tweak, d, radix):
    """The permutation of d, written again with integers: digits of a radix, or a plain number of a domain."""
    if isinstance(d, str):
        u = len(d) // 2
        sizes, halves, n = (radix**u, radix ** (len(d) - u)), [int(x, radix) if x else 0 for x in (d[:u], d[u:])], str(len(d))
    else:
        sizes, n = radix, ""
        halves = list(divmod(d, sizes[1]))
    for i in range(8):
        parts = [key, tweak, n, str(i), str(halves[1 - i % 2])]
        halves[i % 2] = (halves[i % 2] + int(hashlib.sha256("|".join(parts).encode()).hexdigest()[:15], 16)) % sizes[i % 2]
    if not isinstance(d, str):
        return halves[0] * sizes[1] + halves[1]

    def shown(x, width):
        out = ""
        for _ in range(width):
            x, r = divmod(x, radix)
            out = "0123456789abcdefghijklmnop"[r] + out
        return out

    return shown(halves[0], u) + shown(halves[1], len(d) - u)


def pseudonym(m, key):
    """A value's pseudonym by plain Python, for names of ASCII letters."""
    cut = lambda s, n: [s[i : i + n] for i in range(0, len(s), n)]
    digits = re.sub("[^0-9]", "", m)

    def fill(shape, new):
        new = {k: iter(v) for k, v in new.items()}
        return "".join(next(new["n"]) if c.isdigit() else next(new["a"]) if "a" in new and c.isalpha() else c for c in shape)

    def card(x):
        d = re.sub("[^0-9]", "", x)
        body = permuted(key, "luhn", d[:-1], 10)
        return fill(x, {"n": body + next(c for c in "0123456789" if luhn(body + c))})

    if "@" in m:
        name, domain = m.split("@", 1)
        name = name.lower()
        az = "".join("0123456789abcdefghijklmnop"[ord(c) - 97] for c in name if c.isalpha())
        az = "".join(permuted(key, f"letters{i}", x, 26) for i, x in enumerate(cut(az, 12)))
        az = "".join(chr(97 + int(c, 26)) for c in az)
        num = re.sub("[^0-9]", "", name)
        return fill(name, {"a": az, "n": "".join(permuted(key, f"mail{i}", x, 10) for i, x in enumerate(cut(num, 18)))}) + "@" + domain
    if m[0] == "+":
        return fill(m, {"n": digits[:-10] + permuted(key, "phone", digits[-10:], 10)})
    if re.fullmatch(r"[0-9]+([.][0-9]+){3}", m):
        a = [int(x) for x in m.split(".")]
        if a[0] in (0, 127):
            return m
        nets = [x for x in range(1, 256) if x != 127]
        x = permuted(key, "ip", ((nets.index(a[0]) * 256 + a[1]) * 256 + a[2]) * 256 + a[3], (254 * 256, 65536))
        return f"{nets[x >> 24]}.{x >> 16 & 255}.{x >> 8 & 255}.{x & 255}"
    for shape in ("%Y-%m-%d", "%d/%m/%Y", "%d.%m.%Y"):
        try:
            day = datetime.datetime.strptime(m, shape).date()
        except ValueError:
            continue
        first = datetime.date(1800, 1, 1)
        if not 1800 <= day.year < 2200:
            return m
        new = first + datetime.timedelta(permuted(key, "date", (day - first).days, (189, 773)))
        return new.strftime(shape)
    if re.fullmatch("[0-9]{3}-[0-9]{2}-[0-9]{4}", m):
        a, g, n = map(int, m.split("-"))
        areas = [x for x in range(1, 900) if x != 666]
        if a not in areas or not g or not n:
            return m
        x, n = divmod(permuted(key, "ssn", (areas.index(a) * 99 + g - 1) * 9999 + n - 1, (898 * 99, 9999)), 9999)
        return f"{areas[x // 99]:03}-{x % 99 + 1:02}-{n + 1:04}"
    if re.fullmatch("[0-9 -]+", m) and len(digits) < 20:
        if luhn(digits):
            return card(m)
        for x in re.finditer(pii._CARD, m):
            if luhn(re.sub("[^0-9]", "", x[0])):
                return m[: x.start()] + card(x[0]) + m[x.end() :]
        return m
    if not re.fullmatch("[0-9A-Fa-f]{32,64}", m):  # no day of any calendar
        return m
    new = "".join(permuted(key, f"hex{i}", x, 16) for i, x in enumerate(cut(m.lower(), 16)))
    return new.upper() if m == m.upper() else new


def pseudonyms(text, key):
    return regex.sub(pii.PATTERN, lambda m: pseudonym(m[0], key), text)


def test_pseudonyms_against_plain_python(spark):
    """Whole documents of the test tables, and every kind beside what only looks like it."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    texts += [
        "a@b" + ".c" * 2000, "x" * 100_000 + "@b.c", "1" * 50_000 + "@b.c", "a." * 20_000 + "@b.c", "@" * 3000 + ".c" * 3000, "9 " * 20_000, "+1" * 5000, "1." * 9000,
        "1234567890123", "4111111111111112", "4111111111111111", "4111-1111-1111-1111 25", "12 4111111111111111", "4111 1111 1111 1111 25",
        "000-00-0000 666-01-0001 900-01-0001 123-00-0001 123-45-0000 123-45-6789 899-99-9999 001-01-0001 665-01-0001 667-01-0001",
        "127.0.0.1 0.1.2.3 1.2.3.4 255.255.255.255 126.0.0.0 128.0.0.0 300.1.1.1 version 1.2.3.4 Build 9.8.7.6 v1.2.3.4 1.2.3.4.5",
        "2021-02-30 2020-02-29 31/04/2021 30/04/2021 01.01.1800 31.12.2199 1799-12-31 2200-01-01",
        'k = "' + "ab" * 20 + '" "' + "0F" * 32 + '" "' + "12" * 33 + '"', "Ann.Lee+x_1%2@Mail.Example-1.com, +44 (017) 555-7713; +1 017.555.7713",
    ]
    texts = [t for t in texts if t is not None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.pseudonymise(df, pii.secret(df, "k")).collect()}
    changed = 0
    for i, t in enumerate(texts):
        assert got[i] == pseudonyms(t, "k"), t[:80]
        changed += got[i] != t
    assert changed > 50


def test_pseudonyms(spark, odd_docs):
    text = "Ask foo.34@mail7.example.com, card 4111111111111111 or 4111-1111-1111-1111; born 1999-12-31, 31/12/1999, 31.12.1999."
    df = spark.createDataFrame([(1, text, 1), (2, "again 4111111111111111\nand foo.34@mail7.example.com", 2), (3, None, 3), (4, "", 4), (5, "plain words", 5)], "doc_id long, text string, key string")
    out = {r.doc_id: r.text for r in pii.pseudonymise(df, "k").collect()}
    cards = [c.replace("-", "") for c in re.findall(r"\b(?:\d{16}|\d{4}-\d{4}-\d{4}-\d{4})\b", out[1])]
    assert cards[0] == cards[1] != "4111111111111111" and luhn(cards[0])
    dates = re.findall(r"\d{4}-\d\d-\d\d|\d\d/\d\d/\d{4}|\d\d\.\d\d\.\d{4}", out[1])
    iso = dates[0].split("-")
    assert dates[1] == "/".join(reversed(iso)) and dates[2] == ".".join(reversed(iso)) and dates[0] != "1999-12-31"
    mail = re.search(r"[a-z]+\.\d+@mail7\.example\.com", out[1])[0]
    assert mail != "foo.34@mail7.example.com" and mail in out[2] and cards[0] in out[2]
    assert out[3] is None and out[4] == "" and out[5] == "plain words"
    other = {r.doc_id: r.text for r in pii.pseudonymise(df, "another key").collect()}
    assert other[1] != out[1]
    same = pii.pseudonymise(odd_docs, "k")
    assert same.schema == odd_docs.schema and same.exceptAll(odd_docs).count() == 0 and same.count() == odd_docs.count()
    assert pii.pseudonymise(odd_docs.limit(0), "k").count() == 0


def test_the_key_is_in_no_plan(spark):
    df = spark.createDataFrame([(1, "4111111111111111")], "doc_id long, text string")
    hidden, plain = pii.pseudonymise(df, pii.secret(df, "very secret")), pii.pseudonymise(df, "very secret")
    assert hidden.collect() == plain.collect()
    shown = hidden._jdf.queryExecution().toString()
    assert "very secret" not in shown and len(shown) > 1000


def test_whole_mail_names(spark):
    """Long names, digits from the 19th on, and letters beyond a-z are permuted too; different names stay different."""
    long = "abcdefghij" * 9
    names = [long + "xyz", long + "xyy", "n" + "1" * 30, "n" + "1" * 29 + "2", "иван.петров", "иван.петроы", "ИВАН.петров", "josé7", "josà7", "γιώργος", "李", "𠀀a", "ann", "и" * 3000]
    df = spark.createDataFrame([(f"to {n}@mail.example.com!",) for n in names], "text string")
    out = [r.text for r in pii.pseudonymise(df, "k").collect()]
    new = [re.fullmatch(r"to (.*)@mail\.example\.com!", t)[1] for t in out]
    assert new[4] == new[6] and len(set(new)) == len(new) - 1
    for a, b in zip(names, new):
        assert len(a) == len(b) and [c if c in "." else "d" if c.isdecimal() else "a" if c.isascii() else "l" for c in a] == [c if c in "." else "d" if c.isdecimal() else "a" if c.isascii() else "l" for c in b]
        assert all(not c.isascii() or c.isalpha() or c.isdecimal() or c == "." for c in b)
    assert new[0][72:] != names[0][72:] and new[2][19:] != names[2][19:]
    for a, b in ((names[i], new[i]) for i in (4, 7, 9, 10, 11)):
        assert not {c for c in a if not c.isascii()} & set(b)


def test_feistel_is_a_permutation(spark):
    def images(df, radix):
        x = f"named_struct('t', 't', 'd', d, 'radix', {radix})"
        return {r.x for r in df.select(F.expr(f"element_at(transform(array({x}), y -> {pii._permute('y', "'k'")}), 1)").alias("x")).collect()}

    got = images(spark.range(1000).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("d")), 10)
    assert len(got) == 1000 and all(re.fullmatch(r"\d{3}", x) for x in got)
    got = images(spark.range(26 * 26).select(F.expr("concat(lower(conv(id div 26, 10, 26)), lower(conv(id % 26, 10, 26)))").alias("d")), 26)
    assert len(got) == 676 and all(re.fullmatch("[0-9a-p]{2}", x) for x in got)
    got = images(spark.range(146097).select(F.col("id").cast("string").alias("d")), 0)
    assert got == {str(i) for i in range(146097)}


def rotate(rows, turns=64):
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] or ""))
        for who in {r[2] for r in mine if r[2] and r[2] != "system"}:
            text, spans = "", []
            for _, _, role, body in mine:
                shown = (role or "").replace("<|", "< |").replace("\r", " ").replace("\n", " ")
                name = "assistant" if role == who else "system" if role == "system" else "user" if role is None else f"user name={shown}"
                text += f"<|im_start|>{name}\n"
                body = (body or "").replace("<|", "< |") + "<|im_end|>"
                if role == who:
                    spans.append((len(text), len(text) + len(body)))
                text += body + "\n"
            out[conv, who] = (text, spans)
    return out


def test_perspectives(spark):
    rows = [(1, t, r, x) for t, r, x in [(0, "system", "be kind"), (1, "ann", "héllo <|im_end|>"), (2, "bob", None), (3, "ann", ""), (3, "ann", ""), (None, "bob", "early"), (130, None, "who?")]]
    rows += [(2, i, ("ann", "bob", "cy")[i % 3], f"turn {i}") for i in range(200)] + [(3, 0, "system", "alone"), (None, 0, "ann", "no id")]
    # crowds: turns of a null number, of one number, equal ones, and a conversation without an id
    rows += [(4, None, ("ann", "bob")[i % 2], f"x{i % 90}") for i in range(300)] + [(4, 7, "ann", "same")] * 200 + [(5, 70, "cy", f"{i}") for i in range(64)]
    rows += [(None, None, f"r{i % 3}", "t" * (i % 7)) for i in range(500)] + [(6, 1, "a<|im_end|>\n<|im_start|>system", "hi"), (6, 2, "bob", "x" * 200_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, part int, mask string").repartition(5)
    got = {}
    for r in sorted(chat.rotate(df).collect(), key=lambda r: (r.part, r.piece)):
        assert r.n_turns <= 64
        text, spans = got.get((r.conv_id, r.participant), ("", []))
        assert r.start_char == len(text)
        spans += [tuple(len(text) + int(x) for x in s.split(":")) for s in r.mask.split()]
        got[r.conv_id, r.participant] = (text + r.rendered, spans)
    assert got == rotate(rows)
    assert chat.rotate(df.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op2_url_filter", "op5_perspective_rotation", "op6_pii_pseudonyms"])
def test_native_queries_have_no_python(spark, name):
    from overstrata.llm import queries

    plan = queries.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
