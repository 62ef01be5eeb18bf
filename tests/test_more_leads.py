"""Secrets of forms that the given tables do not hold."""

import hashlib

from tracelight.operators import leaks


def test_leads_of_all_forms(spark):
    pem = lambda body: f"-----BEGIN RSA PRIVATE KEY-----\n{body}\n-----END RSA PRIVATE KEY-----"
    cut = lambda text: text[: text.index("END") + 3]
    rows = [
        ("a", 'secret = "abcd1234efgh"', "secret", "abcd1234efgh"), ("b", "api_key: k_12345678", "api_key", "k_12345678"),
        ("c", 'token = "ABCDEFGH12"', "api_token", "ABCDEFGH12"), ("d", f'token = "{"0a" * 20}"', "api_token", "0a" * 20),
        ("e", "password: longpass-1", "password", "longpass-1"), ("f", "password=abcdefgh1", "password", "abcdefgh1"),
        ("g", "x " + pem("MIIa-b\n" * 20_000) + " y", "private_key", cut(pem("MIIa-b\n" * 20_000))), ("h", pem("other"), "private_key", cut(pem("other"))),
        ("i", "-----BEGIN PRIVATE KEY----- and no end", "private_key", "-----BEGIN PRIVATE KEY-----"), ("j", "AKIA" + "B" * 16, "access_key", "AKIA" + "B" * 16),
    ]
    docs = spark.createDataFrame([(s, t) for s, t, _, _ in rows] + [("k", "token = short, secret of -----BEGIN CERTIFICATE-----"), ("l", None)], "source string, text string")
    got = {(r.source_artifact, r.secret_type, r.fingerprint, r.sightings) for r in leaks.secret_leads(docs).collect()}
    assert got == {(s, kind, hashlib.sha256(v.encode()).hexdigest(), 1) for s, _, kind, v in rows}
