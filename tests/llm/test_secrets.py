import hashlib
import random
import re

from tideline.llm.secrets import find_secrets, secret_digest

RULES = {
    "assign": (re.compile(r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    "hex": (re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
}


def brute(text):
    return sorted((m.start(), k, kind, m.end()) for k, (kind, (rule, ok)) in enumerate(RULES.items()) for m in rule.finditer(text) if ok(m))


def corpus():
    rng = random.Random(3)
    parts = ["password", "PassWd", "secret", "api_key", "apikey", "token", "=", ":", " ", "  ", '"', "'", "abcdef", "short", "é", "日", "AKIA", "AKIAAKIA", "ABCDEFGH1234567890", "deadbeef0123", "0123456789abcdef01234567", "\n", "tokentoken=abc123", "x==y=z", ".", "-"]
    return [(i, "".join(rng.choices(parts, k=rng.choice([1, 8, 40, 300])))) for i in range(250)] + [(250, ""), (251, None), (252, "a" * 200000), (253, "password = " + "q" * 100000)]


def test_matches_regular_expressions(spark):
    found = find_secrets(spark.createDataFrame([(*r, "x") for r in corpus()], "doc_id long, text string, spans string"))
    got = {r.doc_id: r for r in secret_digest(found).collect()}
    spans = {r.doc_id: r.spans for r in found.collect()}
    for i, text in corpus():
        want = brute(text or "")
        base = [(s.start, s.kind, s.end) for s in spans[i] if s.kind in RULES]
        assert base == [(a, kind, b) for a, _, kind, b in want], text
        listed = ",".join(f"{kind}:{a}:{b}" for a, _, kind, b in want)
        assert got[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(w[2] == kind for w in want) for kind in RULES)


def test_more_rules_and_edges(spark):
    text = "-----BEGIN RSA PRIVATE KEY-----\nghp_abcdefghijklmnopqrstuvwxyz0123 eyJhbGci.eyJzdWIi.c2ln"
    df = spark.createDataFrame([(None, text), (1, text), (1, text)], "doc_id long, text string")
    assert [sorted(s.kind for s in r.spans) for r in find_secrets(df).collect()] == [["hosting", "jwt", "pem"]] * 3
    assert find_secrets(df.limit(0)).collect() == []
