"""Values beside other numbers, and further forms of dates and phone numbers."""

from __future__ import annotations

import re

from ledgerlens.llm import pseudonyms


def run(spark, texts):
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    return [r["text"] for r in pseudonyms.pseudonymise(table, "k").orderBy("row.doc_id").collect()]


def test_cards_beside_numbers(spark):
    card = "4111 1111 1111 1111"
    texts = [
        card, f"{card} 12/27", f"{card} 123", "item 12 4111111111111111", f"{card} 2020-02-29", f"{card} 310-555-4510",
        f"{card} 5500 0000 0000 0004 12th", "1 2 3 4111-1111-1111-1111 77 88", "4111 1111 1111 1112 12/27",
    ]
    out = run(spark, texts)
    new = out[0]
    plain = new.replace(" ", "")
    assert re.fullmatch(r"\d{4} \d{4} \d{4} \d{4}", new) and new != card
    assert out[1] == f"{new} 12/27" and out[2] == f"{new} 123" and out[3] == f"item 12 {plain}"
    assert re.fullmatch(rf"{new} \d{{4}}-\d\d-\d\d", out[4]) and "2020-02-29" not in out[4]
    assert re.fullmatch(rf"{new} \d{{3}}-\d{{3}}-\d{{4}}", out[5]) and "310-555-4510" not in out[5]
    assert re.fullmatch(rf"{new} \d{{4}} \d{{4}} \d{{4}} \d{{4}} 12th", out[6]) and "5500 0000" not in out[6]
    assert out[7] == f"1 2 3 {new.replace(' ', '-')} 77 88" and out[8] == texts[8]


def test_dates_before_times_and_month_first(spark):
    out = run(spark, ["2020-12-25", "at 2020-12-25T10:00:00Z 7", "on 12/25/2020 8", "25/12/2020", "13/32/2020 2020-13-01T1"])
    y, m, d = out[0].split("-")
    assert out[0] != "2020-12-25" and out[1] == f"at {out[0]}T10:00:00Z 7"
    assert out[2] == f"on {m}/{d}/{y} 8" and out[3] == f"{d}/{m}/{y}"
    assert out[4] == "13/32/2020 2020-13-01T1"


def test_forms_of_phones(spark):
    forms = ["+1 310 555 4510", "+13105554510", "310-555-4510", "(310)555-4510", "(310) 555-4510", "1-310-555-4510", "310.555.4510"]
    out = run(spark, [f"call {f} 12 or" for f in forms])
    local = set()
    for form, text in zip(forms, out, strict=True):
        got = re.fullmatch(r"call (.*) 12 or", text).group(1)
        assert re.sub(r"\d", "0", got) == re.sub(r"\d", "0", form) and got != form
        local.add(re.sub(r"\D", "", got)[-10:])
    assert len(local) == 1
    german = run(spark, ["+49 30 12345678 9", "+493012345678", "+49 (30) 12345678", "+33 1 23 45 67 89", "+33123456789"])
    digits = [re.sub(r"\D", "", t.removesuffix(" 9")) for t in german]
    assert digits[0] == digits[1] == digits[2] != "493012345678" and digits[3] == digits[4] != "33123456789"
