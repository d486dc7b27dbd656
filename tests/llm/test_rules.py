"""Quality rules, personal data and secrets against brute force."""

import collections
import hashlib
import re

import pytest

from medialoom.llm import pii, quality, queries, secrets


CLEAN = " ".join(f"{a}{i} {b}{i}" if i % 3 else f"{a} {b}{i}" for i, (a, b) in enumerate(zip(("the", "and", "that", "was") * 10, ("word", "house", "river", "stone", "light") * 8)))


def key(r):
    return (r[0] is None, r[0] or 0, *map(str, r[1:]))


# ---------------------------------------------------------------- quality

def brute_quality(i, t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    g = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
    c, cover = collections.Counter(g), set()
    for k, x in enumerate(g):
        if c[x] > 1:
            cover |= {k, k + 1, k + 2}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w))


def test_quality(odd, odd_rows, empty):
    got = quality.quality_report(odd).collect()
    assert sorted((tuple(r[:7]) for r in got), key=key) == sorted((brute_quality(*r) for r in odd_rows), key=key)
    assert all(not r["kept"] for r in got if r["base_failed"])
    assert quality.quality_report(empty).count() == 0


def test_quality_rules(spark):
    clean = CLEAN
    rows = [(1, clean), (2, clean.replace(" ", "### ")), (3, clean.upper()), (4, " ".join("x" + w for w in clean.split())), (5, clean + " that" * 150), (6, "De " * 60), (7, " \n".join(["one line of text here", clean] + ["menu entry"] * 20))]
    got = {r["doc_id"]: r["broken"] for r in quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == "" and got[2] == "symbols,stop_words" and got[3] == "capitals_by_char" and got[4] == "stop_words"
    assert "repeated_windows" in got[5] and "repeated_windows" in got[6] and got[7] == "duplicate_lines"


def test_filtered_keeps_clashing_columns(spark):
    clean = CLEAN
    df = spark.createDataFrame([(1, clean, True, 5), (2, "short", False, 6)], "doc_id long, text string, q_kept boolean, c0 int")
    got = quality.filtered(df)
    assert got.columns == df.columns and [tuple(r) for r in got.collect()] == [(1, clean, True, 5)]


def test_quality_is_one_projection_without_user_code(odd):
    plan = quality.quality_report(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


# ---------------------------------------------------------------- personal data

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    s = [int(c) for c in digits[::-1]]
    return sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(s)) % 10 == 0


def brute_pii(t):
    out = []
    for rank, (kind, p) in enumerate(BASE):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 14 <= len(d) <= 19 and luhn(d), "phone": lambda: 10 <= len(d) <= 15}.get(kind, lambda: True)()
            if ok:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


TEXTS = [
    "mail a.b+c@x-y.example.com, or a@b.com_x@y.org; a@b @c.de a@b..c d@e.f.", "ip 1.2.3.4.5.6.7.8 and 256.1.1.1 then 001.000.255.0255 10.0.0.1x9.9.9.9", "card 4111 1111 1111 1111 and 4111-1111-1111-1112 or 378282246310005, 30569309025904 79927398713",
    "call +1 (509) 555-6973 or +49 89 1234567 89.. +1 2 +123 (0) and +1 (826) 555-4081 190.137.223.204", "漢字 😀 mail: ü@x.de é.a@b.co 5.6.7.8 ñ+34 600 000 0000", None, "", "@" * 50, "1" * 3000, "a" * 5000 + "@b.cc", "a@" + "b." * 3000 + "c",
    "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, not GB82WEST12345698765433", "SSN 123-45-6789, number 123-45-6789", "+1234567890" * 3, "1.1.1.1,2.2.2.2\n3.3.3.3 4.4.4.4.", "4111111111111111 4111111111111111",
]


def test_pii(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op5_pii(spark, str(tmp_path)).collect()}
    for k, t in rows:
        want = brute_pii(t)
        assert got[k]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (t, want, got[k]["spans"])
        assert [got[k][f"n_{n}"] for n, _ in BASE] == [sum(x.startswith(n) for x in want) for n, _ in BASE]
        assert set(want) <= set(got[k]["spans"].split(",")) or not want
    spans = got[11]["spans"].split(",")
    assert "iban:5:32" in spans and sum(s.startswith("iban") for s in spans) == 2  # mod-97 rejects the third
    assert [s for s in got[12]["spans"].split(",") if s.startswith("ssn")] == ["ssn:4:15", "ssn:24:35"]


def test_context_words_raise_the_score(spark):
    df = spark.createDataFrame([(1, "my mail is a@b.com"), (2, "see a@b.com")], "doc_id long, text string")
    got = {r["doc_id"]: r["spans"][0]["score"] for r in pii.find(df).collect()}
    assert got[1] == pytest.approx(1.2) and got[2] == pytest.approx(0.8)


@pytest.mark.parametrize("before, after", [("SOCIAL SECURITY NUMBER ", ""), ("Ssn: ", ""), ("social Security ", ""), ("sSN ", " x"), ("", " is my SoCiAl sEcUrItY number"), ("social ", " x")])
def test_ssn_in_any_case(spark, before, after):
    df = spark.createDataFrame([(1, f"{before}123-45-6789{after}")], "doc_id long, text string")
    hit = "x" not in after or "ssn" in before.lower()
    assert [(s["kind"], s["match"]) for s in pii.find(df).first()["spans"]] == [("ssn", "123-45-6789")] * hit
    assert pii.redacted(df).first()["text"] == f"{before}{'<SSN>' if hit else '123-45-6789'}{after}"


def test_pii_odd_rows(odd, odd_rows, empty):
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, len(r["spans"])) for r in pii.find(odd).collect())
    assert got == sorted((i is None, i or 0, len(brute_pii(t))) for i, t in odd_rows)
    assert pii.find(empty).count() == 0


def test_redacted(spark):
    rows = [(1, "write to a@b.com or 1.2.3.4 😀.", 99, "p"), (2, None, 0, "q"), (3, "clean", 5, "r"), (4, "+1 509 555 6973 1.2.3.4", 1, "s")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, p_text string")
    got = pii.redacted(df)
    assert got.columns == df.columns
    out = {r["doc_id"]: tuple(r)[1:] for r in got.collect()}
    assert out[1] == ("write to <EMAIL> or <IP> 😀.", 27, "p") and out[2] == (None, 0, "q") and out[3] == ("clean", 5, "r")
    assert "509" not in out[4][0] and "1.2.3.4" not in out[4][0]


def test_pii_is_native(odd):
    plan = pii.find(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


# ---------------------------------------------------------------- secrets

SECRETS = [("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+")]


def brute_secrets(t):
    out = []
    for rank, (kind, p) in enumerate(SECRETS):
        for m in re.finditer(p, t or "", re.ASCII):
            if len(m[2] if rank == 0 else m[0]) >= (6, 20, 24)[rank]:
                out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(out)]


SECRET_TEXTS = [
    'token = "8ef5f278dec875d2b96fdf2916aa" PassWord:abc password=abcdef', "API_KEY='a+/=_.-' apikey = xyzxyz api__key=aaaaaaa", "AKIA" + "A1" * 8 + " AKIA123 xAKIA" + "B" * 20, "é" * 30 + "deadbeef" * 3 + "g" + "0" * 23 + " " + "f" * 24,
    None, "", "paſſword=abcdef toKen=123456", "a" * 4000, "secret" * 500 + "=1234567", "token=token=token=abcdef", "😀 passwd : hunter22\0" + "ab" * 12,
]


def test_secrets(spark, tmp_path):
    rows = [(k, t) for k, t in enumerate(SECRET_TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.op8_secret_scan(spark, str(tmp_path)).collect()}
    for k, t in rows:
        want = brute_secrets(t)
        assert got[k]["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest(), (t, want, got[k]["spans"])
        assert [got[k][f"n_{n}"] for n, _ in SECRETS] == [sum(x.startswith(n) for x in want) for n, _ in SECRETS]


def test_added_rules():
    s = secrets.Scanner()
    found = s.scan(["x ghp_" + "aZ" * 18, "-----BEGIN RSA PRIVATE KEY-----", "xoxb-123456789012", "eyJhbGciOiJI.eyJzdWIiOiIx.abc", "AIza" + "x" * 35])
    assert [{x["kind"] for x in f} for f in found][0] == {"code_host_token"} and [f[0]["kind"] for f in found[1:3]] == ["private_key", "chat_token"]
    assert found[3] == [] and found[4][0]["kind"] == "map_key"


def test_trigram_queries():
    q = secrets.trigram_query
    assert q("abcd") == ("and", ("abc", "bcd")) and q("ab") is True and q("[0-9a-f]+") is True
    assert q("(abc|xyz)+") == ("or", ("abc", "xyz")) and q("(abc|x)") is True and q("a?bcd") != True  # noqa: E712
    assert q("AKIA[A-Z0-9]+") == ("and", ("aki", "kia")) and q("abc.*def") == ("and", ("abc", "def")) and q("(?:abc)*") is True
    assert q("(?i:SeCret)") == ("and", ("sec", "ecr", "cre", "ret"))


def test_query_never_loses_a_match():
    s = secrets.Scanner()
    for t in (x for x in SECRET_TEXTS if x):
        seg = secrets.Segment([t], s.table, len(s.ids))
        for r in s.rules:
            if r.spans(t):
                assert 0 in seg.matching(r.query, s.ids)


def test_secrets_odd_rows(odd, odd_rows, empty):
    assert secrets.find(odd).count() == len(odd_rows) and secrets.find(empty).count() == 0
