"""Account numbers before capitals, digits and each other."""

from tracelight.llm import pii

DE, GB, NO = "DE89370400440532013000", "GB29 NWBK 6016 1331 9268 19", "NO9386011117947"


def test_account_numbers_end_where_they_end(spark):
    def numbered(country, body):
        turned = "".join(str(int(c, 36)) for c in body + country + "00")
        return f"{country}{98 - int(turned) % 97:02d}{body}"

    other = numbered("ZZ", "ABCD1234567890123")  # a country without a registered length
    rows = [
        (f"pay {DE} Please", [DE]), (f"pay {DE} 2 items", [DE]), (f"{DE} BIC COBADEFFXXX", [DE]), (f"to {DE} {GB} {NO}", [DE, GB, NO]),
        (f"{GB} OR {DE}", [GB, DE]), (f"é {NO}, Then", [NO]), (f"{other} Then", [other]), (DE, [DE]), (f"{DE}x", []), (f"{DE}4", []), (f"x{DE}", []),
        (f"{DE[:-1]}1 Please", []), ("DE89 3704", []), ("DE12" + " A1" * 500, []), (None, []),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    for r in pii.find_pii(docs).collect():
        text, want = rows[r.doc_id]
        spans = [s for s in r.all_spans if s["kind"] == "iban"]
        assert [s["match"] for s in spans] == want, text
        assert all(text[s["start"]:s["end"]] == s["match"] for s in spans)
    clean = {r.doc_id: r.text for r in pii.redact_pii(docs).collect()}
    assert clean[0] == "pay <IBAN> Please" and clean[3] == "to <IBAN> <IBAN> <IBAN>" and clean[9] == f"{DE}4"
