import hashlib
import re

from odd import documents, odd_rows

from gleaner.llm import ownership, pii

HEX = "04dbebab91ab85687d33eeaaf9ac699e1188f962"


def sha(spans):
    return hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()


def secrets(text):
    out = []
    for kind, pattern, keep in (
            ("assign", r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""",
             lambda m: len(m[2]) >= 6),
            ("access", "AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
            ("hex", "[0-9a-f]+", lambda m: len(m[0]) >= 24)):
        out += [(kind, *m.span()) for m in re.finditer(pattern, text) if keep(m)]
    return sorted(out, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


SECRETS = [(10, f'é token = "{HEX}" and ToKeN:abcdef password=short AKIA' + "A1" * 9, "a"),
           (11, f"api-key api_key='{HEX}' apikey: x/y+z==", "b"), (12, f"secret {HEX}{HEX}", "b"),
           (13, "ghp_" + "aB3dE5gH" * 5, "c"), (14, "ſecret=abcdefgh " + "deadbeef" * 3000, "c"),
           (15, "AKIAAKIA" + "Z" * 12 + "akia", "c")]


def test_secrets_equal_the_patterns(spark):
    rows = odd_rows(SECRETS)
    found = ownership.secret_digest(ownership.secret_spans(documents(spark, rows))).collect()
    assert len(found) == len(rows)
    want = sorted((str(d), sha(secrets(t or ""))) for d, t, _ in rows)
    assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in found) == want
    assert ownership.secret_spans(documents(spark, [])).count() == 0


def test_ownership_parts_examples_from_live_ones(spark):
    own = "9f8e7d6c5b4a39281706f5e4d3c2b1a0"
    rows = [(n, f'token = "{HEX}"', f"s{n}") for n in range(5)] + [(9, f'token = "{own}"', "s1")]
    found = {r["doc_id"]: r["found"] for r in ownership.secret_spans(documents(spark, rows)).collect()}
    assert all(s["owners"] == 5 and not s["live"] for n in range(5) for s in found[n])
    assert all(s["owners"] == 1 and s["repositories"] == 1 and s["live"] for s in found[9])
    # a key form that many owners share is no added span
    keys = [(n, "ghp_" + "aB3dE5gH" * 5, f"s{n}") for n in range(3)] + [(9, "ghp_" + "xY7wV9uT" * 5, "s1")]
    added = {r["doc_id"]: len(r["found"]) for r in ownership.secret_spans(documents(spark, keys)).collect()}
    assert added == {0: 0, 1: 0, 2: 0, 9: 1}


def test_verdict_takes_owners_and_repositories(spark):
    key, example, once = ("ghp_" + x * 5 for x in ("aB3dE5gH", "xY7wV9uT", "kL2mN4pQ"))
    rows = [(1, f"x {key}", "a"), (2, f"x {key}", "b")]                     # a key and a copy elsewhere
    rows += [(10 + n, f"x {example}", "hot") for n in range(120)]           # an example all over one source
    rows += [(200 + n, f"x {once}", "hot") for n in range(4)]               # a key repeated by its owner
    rows += [(300 + n, "x ghp_" + "cD6fG8hJ" * 5, f"s{n}") for n in range(4)]
    got = {r["doc_id"]: r for r in ownership.secret_spans(documents(spark, rows)).collect()}
    assert len(got) == len(rows)
    for d, r in got.items():
        live = d < 10 or 200 <= d < 300
        assert (len(r["found"]), len(r["aside"])) == ((1, 0) if live else (0, 1))
        assert all(s["live"] == live for s in r["found"] + r["aside"])
    assert got[1]["found"][0]["owners"] == got[1]["found"][0]["repositories"] == 2
    told = {r["doc_id"]: (r["spans"], r["aside"]) for r in ownership.secret_digest(
        ownership.secret_spans(documents(spark, rows))).collect()}
    assert told[1] == ("key:2:46", "") and told[10] == told[300] == ("", "key:2:46")


def personal(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
                          ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
                          ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            total = sum(int(c) if n % 2 == 0 else sum(map(int, str(2 * int(c)))) for n, c in enumerate(digits[::-1]))
            if kind == "card" and not (16 <= len(digits) <= 19 and total % 10 == 0):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, *m.span()))
    return out


PERSONAL = [(20, "é a.b@c.d@e.f @x.y x@ x@y x@y. m%+n@sub.example.com a@b..c"),
            (21, "1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255 1.2.3 9.9.9.9999"),
            (22, "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1111 1111 12 3"),
            (23, "+1 (017) 555-7713 +12 ++49 30 123456 +1.2.3.4 +123456789012345678"),
            (24, "9" * 3000 + "." + "a" * 3000 + "@" + "b" * 50 + "1.1" * 900)]


def test_personal_data_equals_the_patterns(spark):
    rows = odd_rows([(d, t, "a") for d, t in PERSONAL])
    found = pii.personal_digest(pii.personal_data(documents(spark, rows))).collect()
    assert len(found) == len(rows)
    assert sorted((str(r["doc_id"]), r["base_sha256"]) for r in found) == sorted(
        (str(d), sha(personal(t or ""))) for d, t, _ in rows)
    assert pii.personal_data(documents(spark, [])).count() == 0


def test_added_spans_and_redaction(spark):
    rows = [(n, f"write to user{n}@mail.example.com or call +1 (017) 555-77{n:02d} from 10.0.0.{n}", "a")
            for n in range(60)]
    rows += [(100, "card 4111 1111 1111 1111 lost", "a"), (101, "version 1.2.3 of 2024, 555 words", "a"),
             (102, None, "a"), (100, "card 4111 1111 1111 1111 lost", "a")]
    docs = documents(spark, rows)
    found = pii.personal_data(docs)
    covered = {r["doc_id"]: r["text"] for r in pii.redact(docs, found).collect()}
    assert pii.redact(docs, found).count() == len(rows)
    assert covered[3] == "write to [EMAIL] or call [PHONE] from [IP]"
    assert covered[100] == "card [CARD] lost" and covered[101] == rows[61][1] and covered[102] is None
