import hashlib
import random
import re

import pytest

from relscope.llm import queries, secret_scan

SF = "/root/testdata/sf0.01"


def plain(text):
    """The base spans by the patterns as they are given, every match in turn."""
    assign = r"([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    out = [("assign", m.start(), m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ["assign", "access", "hex"].index(s[0])))


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_query(spark):
    rows = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op12_secret_scan(spark, SF).collect()
    assert len(got) == len(rows)
    for r in got:
        want = plain(rows[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, _, _ in want) for kind in secret_scan.BASE)
        assert [s for s in r.spans.split(",") if s and not s.startswith("novel")] == [s for s in joined(want).split(",") if s]
    assert sum(r.n_assign for r in got)
    # prose has nothing that compresses badly in a sensitive place
    assert not any("novel" in r.spans for r in got)


def test_patterns_on_odd_texts():
    rng = random.Random(5)
    parts = ["token", "TOKEN", "toKen", "api_key", "apikey", "paſsword", "password", "passwd", "secret", "\"", "'", " ", "  ", ":", "=", "==", "abcdef", "abcde", "AKIA", "A1B2C3D4", "0123456789abcdef", "fade", "ü", "\n", "-", "."]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 24)))
        assert secret_scan.base_spans(text, bool(secret_scan.SENSITIVE.search(text))) == plain(text), text


#: Sentences that neither the dictionary nor its rule has: what is between the bars is a secret.
HELD_OUT = """
AWS_SECRET_ACCESS_KEY=|wJalrXUtnFEMI/K7MDENG/bPxRfiCYzEXQMPL|
Authorization: Bearer |eyJhbGciOiJIUzI1NiIsInR5cCI6.x9Kq2vB7zz0| was logged
his passphrase is |Tr0ub4dor_3xQ9| I think
export client_id |3f2504e0-4f89-41d3-9a0c-0305e82c3301|
the signing key |Zk9Q2xY7pL0w| and once more, the signing key |Zk9Q2xY7pL0w| is here
the accounts' credentials were (|mY8sT0ng9pX4|) last week
pwd "|7hQ2kLm9XvB3nR5t|" works
the secret Wirtschaftswunderkind of the town
this token calls parseRequestHeader and updateSessionTokenId first
the private key lies in /usr/local/share/config.json as before
the password was changed on 2024-11-03T10:22:31 in release-2024.11.03-final
see the secret meeting in CONFIGURATION_DEFAULT or 1234567890123
a commit 9fQ2xY7pL0wZk3 without anything near it
the token economy of internationalisation and counterrevolutionaries
""".strip().splitlines()


def test_held_out_sentences():
    novelty = secret_scan.Novelty()
    for line in HELD_OUT:
        pieces = line.split("|")
        text = "".join(pieces)
        assert [text[a:b] for k, a, b in secret_scan.find(text, novelty) if k == "novel"] == pieces[1::2], line


def test_what_stands_around_counts():
    novelty, key = secret_scan.Novelty(), "Zk9Q2xY7pL0wA1s2D3"
    text = f"the list {key[:-1]}x and {key[:-2]}yy; password {key}"
    assert novelty.of(text, text.index(key), text.index(key) + len(key)) < secret_scan.NOVEL <= novelty.of(f"password {key}", 9, 9 + len(key))


def test_odd_rows(spark):
    long = "x" * 300000 + " secret Zk9Q2xY7pL0w " + "y" * 300000
    rows = [(1, None), (1, ""), (None, "token=abcdef"), (2, "token=abcdef"), (2, "token=abcdef"), (3, "é token = 'abcdef'"), (4, long), (5, "tokentoken" * 2000)]
    docs = spark.createDataFrame([(*r, "clash", 7) for r in rows], "doc_id long, text string, spans string, kind int")
    got = sorted(((r.doc_id is None, r.doc_id or 0), [tuple(s) for s in r.spans]) for r in secret_scan.secrets(docs).collect())
    assert [g[1] for g in got] == [[], [], [("assign", 0, 12)], [("assign", 0, 12)], [("assign", 2, 17)], [("novel", 300008, 300020)], [], [("assign", 0, 12)]]
    assert secret_scan.secrets(docs.limit(0)).count() == 0


@pytest.mark.parametrize("lines", [None, [f"{v}_{n}" for v in "alpha beta gamma delta".split() for n in map(str, range(500))]])
def test_own_dictionaries(lines):
    novelty = secret_scan.Novelty(lines, 4096)
    assert secret_scan.find("secret 9fQ2xY7pL0wZk3", novelty) == [("novel", 7, 21)]
