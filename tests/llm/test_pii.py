import re

from pyspark.sql import functions as F

from rulemill.llm.pii import NAMES, anonymise, entity_type, passes_luhn, surrogates


def luhn(number):
    digits = [int(c) for c in number if c.isdigit()]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits))) % 10 == 0


def anonymous(spark, texts, key="k"):
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in anonymise(frame, key).orderBy("doc_id").collect()]


def test_shapes_types_and_coreference(spark):
    texts = [
        "Mail ann.b1@mail7.example.com, then ANN.B1@mail7.example.com.",
        "Call +1 (017) 555-7713 from 97.51.17.173; card 4111 1111 1111 1111 or 4539578763621486.",
        'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" and SSN 123-45-6789',
        "Mr. John Smith met Mrs. Jane Smith, and Dr. Smith left. господин Иван Петров, г-н Петров.",
        "again 97.51.17.173",
    ]
    out = anonymous(spark, texts)
    for old, new in zip(texts, out):
        for entity in re.findall(r"\S*\d\S*|Smith|John|Jane|Иван|Петров", old):
            assert entity.strip(".,;") not in new or len(entity) < 4
    mails = re.findall(r"[\w.]+@[\w.]+\.com", out[0])
    assert len(mails) == 2 and mails[0] == mails[1] and re.fullmatch(r"[a-z]{3}\.[a-z]\d@[a-z]{4}\d\.[a-z]{7}\.com", mails[0])
    assert re.fullmatch(r"Call \+1 \(\d{3}\) \d{3}-\d{4} from (\d+\.){3}\d+; card 4\d{3} \d{4} \d{4} \d{4} or 4\d{15}\.", out[1])
    assert luhn(out[1].split("card ")[1].split(" or")[0]) and luhn(out[1].split("or ")[1])
    assert re.fullmatch(r'token = "[0-9a-f]{40}" and SSN \d{3}-\d{2}-\d{4}', out[2])
    man, family, woman, again, doctor = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs\. (\w+) (\w+), and Dr\. (\w+) left\. .*", out[3]).groups()
    assert family == again == doctor and man != woman and woman.endswith("a") or woman in "Helen Alice Irene Edith Mary Sylvia"
    given, one, two = re.search(r"господин (\w+) (\w+), г-н (\w+)\.", out[3]).groups()
    assert one == two and re.fullmatch("[А-Яа-яё]+", given + one)
    assert out[4].split()[1] in out[1]
    assert anonymous(spark, texts) == out and anonymous(spark, texts, "other") != out


def test_clean_texts_stay(spark, prose):
    texts = ["", "Licensed under the Apache License, Version 2.0.", "1234567890123456 is no card", "v1.2.3 and 4.0.", "room 42, 2026-12-01", prose(50), "a@b", "Mr. smith", "300.1.1.1", None, "1.2.3.4.5"]
    assert anonymous(spark, texts) == texts


def test_types(spark):
    cases = {"a@b.org": "email", "1.2.3.4": "ip", "123-45-6789": "ssn", "4111111111111111": "card", "4111111111111112": None, "+49 30 901820": "phone", "(030) 555-1234": "phone", "Ms. Doe": "person", "s3cr3t!": "secret"}
    frame = spark.createDataFrame([(c,) for c in cases], "m string")
    assert {r[0]: r[1] for r in frame.select("m", entity_type(F.col("m"))).collect()} == cases
    numbers = spark.createDataFrame([(str(n),) for n in range(79927398710, 79927398720)], "n string")
    assert [r[0] for r in numbers.filter(passes_luhn(F.col("n"))).collect()] == ["79927398713"]


def test_surrogates_are_distinct_and_new(spark):
    values = [("family", f"Name{chr(97 + i // 26)}{chr(97 + i % 26)}") for i in range(120)] + [("ssn", f"000-00-{i:04}") for i in range(50)]
    frame = spark.createDataFrame(values + values[:9], "type string, value string")
    rows = surrogates(frame, "k").collect()
    assert sorted((r["type"], r["value"]) for r in rows) == sorted(values)
    assert len({(r["type"], r["surrogate"]) for r in rows}) == len(values)
    assert not {(r["type"], r["surrogate"]) for r in rows} & set(values)


def test_surrogates_grow_where_a_pool_or_a_format_is_used_up(spark):
    digits = [("secret", f"****{c}") for c in "0123456789"]
    names = [("given_u", "А" + "".join(chr(ord("а") + int(d)) for d in f"{i:04}")) for i in range(1500)]
    rows = surrogates(spark.createDataFrame(digits + names, "type string, value string"), "k").collect()
    assert len(rows) == len({(r["type"], r["surrogate"]) for r in rows}) == 1510
    assert not {(r["type"], r["surrogate"]) for r in rows} & {*digits, *names}


def test_masked_values_are_no_secrets(spark):
    texts = ['password: "********"', "secret = '------'", 'password: "***7***"', 'token: "пароль секрет", api_key="ひらがなカタ", pwd="비밀번호비밀"']
    out = anonymous(spark, texts)
    assert out[:2] == texts[:2] and re.fullmatch(r'password: "\*\*\*\d+\*\*\*.*"', out[2]) and out[2] != texts[2]
    assert "ひらがなカタ" not in out[3] and re.search('api_key="[ぁ-ゖ]{4}[ァ-ヺ]{2}"', out[3]) and re.search('pwd="[가-힣]{6}"', out[3])


def test_names_of_several_words_and_scripts(spark):
    texts = [
        "Mr John Fitzgerald Kennedy spoke, then Mrs Jane Q. Public.", "Dr. J. Smith and Mr Kennedy left.",
        "Mr Αλέξανδρος Παπαδόπουλος spoke.", "Miss Public, Herr J. R. R. Tolkien",
    ]
    out = anonymous(spark, texts)
    for word in ("John", "Fitzgerald", "Kennedy", "Jane", "Public", "Smith", "Αλέξανδρος", "Παπαδόπουλος", "Tolkien"):
        assert not any(word in text for text in out)
    first, middle, president, jane, public = re.fullmatch(r"Mr (\w+) (\w+) (\w+) spoke, then Mrs (\w+) [A-Z]\. (\w+)\.", out[0]).groups()
    assert {first, middle} <= set(NAMES["given_m", "latin"].split()) and jane in NAMES["given_f", "latin"].split()
    assert re.fullmatch(rf"Dr\. [A-Z]\. \w+ and Mr {president} left\.", out[1]) and re.fullmatch(r"Mr [Α-Ωα-ωάέήίόύώ]+ [Α-Ωα-ωάέήίόύώ]+ spoke\.", out[2])
    assert re.fullmatch(rf"Miss {public}, Herr [A-Z]\. [A-Z]\. [A-Z]\. \w+", out[3])


def test_awkward_rows(spark, awkward, no_rows):
    assert anonymise(no_rows, "k").collect() == []
    texts = ["x 97.51.17.173 y", "x 97.51.17.173 y", None, "no entity"]
    more = spark.createDataFrame([(None if i == 1 else 700, t, "found", "parts", "id") for i, t in enumerate(texts)], "doc_id long, text string, names string, key string, row string")
    docs = awkward.unionByName(more, allowMissingColumns=True)
    out = anonymise(docs, "k")
    assert out.columns == docs.columns and out.count() == docs.count()
    changed = out.filter("names = 'found'").collect()
    assert len({r["text"] for r in changed if r["text"] and r["text"].startswith("x")}) == 1 and sum(r["text"] is None for r in changed) == 1
    rest = lambda df: sorted(map(str, df.filter("names IS NULL").collect()))
    assert rest(out) == rest(docs)


def test_plan_has_no_python(spark, awkward):
    plan = anonymise(awkward, "k")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_numbers_beside_cards_and_phones(spark):
    texts = ["card 4111 1111 1111 1111 12/27", "4111111111111111 123", "order 12 4845168114407329", "tel 555-123-4567 1200 EUR", "4111 1111 1111 1111 555 123 4567", "12-4845168114407329", "4111-1111-1111-1111-123", "3782 822463 10005 99", "1234567890123456 555-123-4567"]
    out = anonymous(spark, texts)
    wanted = [r"card (4\d{3} \d{4} \d{4} \d{4}) 12/27", r"(4\d{15}) 123", r"order 12 (4\d{15})", None, r"(4\d{3} \d{4} \d{4} \d{4}) \d{3} \d{3} \d{4}", r"12-(4\d{15})", r"(4\d{3}-\d{4}-\d{4}-\d{4})-123", r"(3\d{3} \d{6} \d{5}) 99"]
    for old, new, pattern in zip(texts, out, wanted):
        assert pattern is None or old != new and luhn(re.fullmatch(pattern, new)[1]) and re.fullmatch(pattern, old)[1] not in new
    assert "555-123-4567" not in out[3] and re.fullmatch(r"tel \d{3}-\d{3}-\d{4} 1200 EUR", out[3]) and "555 123 4567" not in out[4]
    assert re.fullmatch(r"1234567890123456 \d{3}-\d{3}-\d{4}", out[8]) and "555-123-4567" not in out[8]
