"""What personal names are called elsewhere in a text, more forms of them, and words that
only toxic documents have."""

import random
import re

from pyspark.sql import functions as F

from slicetopo.llm import pii, toxicity


def shown(spark, texts, column="text"):
    df = spark.createDataFrame(list(enumerate(texts)), f"doc_id long, {column} string")
    return [r[column] for r in sorted(pii.pseudonymise(df, "k").collect(), key=lambda r: r.doc_id)]


def test_names_are_replaced_without_a_form_of_address_too(spark):
    got = shown(spark, ["Mr Smith met Mr John Smith, later John Smith and Smith left. SMITH!", "Ms Anna Maria Lopez, Anna, Maria, Lopez", "Smith stays, as nobody calls this one Mr"])
    assert not re.search("smith|john", got[0], re.I) and not re.search("anna|maria|lopez", got[1], re.I)
    name = re.match(r"Mr (\w+) met Mr (\w+) (\w+), later (\w+) (\w+) and (\w+) left\. (\w+)!", got[0]).groups()
    assert name[0] == name[2] == name[4] == name[5] == name[6].capitalize() and name[1] == name[3] and name[6].isupper()
    assert got[2].startswith("Smith stays")


def test_forms_of_names(spark):
    said = ["Mr. O'Brien came", "Mr McDonald came", "Mr J. Smith came", "Herr von Braun came", "MR. JONES came", "Señora García came", "Mr Smith-Jones came", "Dr Anna Maria de la Cruz came"]
    got = shown(spark, said)
    forms = [r"Mr\. \w'[A-Z]\w+", r"Mr [A-Z]\w+", r"Mr [A-Z]\. [A-Z]\w+", r"Herr von [A-Z]\w+", r"MR\. [A-Z]+", r"Señora [A-Z]\w+", r"Mr [A-Z]\w+-[A-Z]\w+", r"Dr [A-Z]\w+ [A-Z]\w+ de la [A-Z]\w+"]
    for before, after, form in zip(said, got, forms, strict=True):
        assert re.fullmatch(form + " came", after), after
        for part in re.findall(r"[^\W\d_]{3,}", before):
            assert part in ("came", "von", "Señora", "Herr") or part not in after, (before, after)
    slavic = shown(spark, ["Г-жа Анна Иванова и Г-н Петров", "Г-н Иванов"])
    assert re.fullmatch(r"Г-жа \w+ \w+ова и Г-н \w+ов", slavic[0]) and slavic[1].endswith("ов")


def test_more_numbers_and_secrets(spark):
    said = ["card 3782-822463-10005", "call 030 1234567 or 0171/12345678", "host fe80::1 up", "password=hunter22 api_key: a1b2c3d4 token = 'zzz999zzz'", "-----BEGIN RSA PRIVATE KEY-----\nMIIEabc123+/=\n-----END RSA PRIVATE KEY-----"]
    got = shown(spark, said)
    for secret in ("822463", "1234567", "12345678", "fe80::1", "hunter22", "a1b2c3d4", "zzz999zzz", "MIIEabc123"):
        assert all(secret not in t for t in got), secret
    assert re.fullmatch(r"card \d{4}-\d{6}-\d{5}", got[0]) and re.fullmatch(r"call 0\d\d \d{7} or 0\d{3}/\d{8}", got[1])
    assert got[3].startswith("password=") and " api_key: " in got[3] and got[4].splitlines()[0] == said[4].splitlines()[0] and got[4].splitlines()[2] == said[4].splitlines()[2]
    plain = ["the secret: meeting at noon", "on 01-02-2024 at 12:30:45", "dead::beef and std::vector", "token ring, key = x"]
    assert shown(spark, plain) == plain


def test_a_text_column_in_any_case(spark):
    got = shown(spark, ["Mr Smith"], column="Text")
    assert got[0].startswith("Mr ") and "Smith" not in got[0]


def test_no_name_that_was_found_is_left_in_its_text(spark):
    rng = random.Random(4)
    names = ["Alder", "Birch", "Cedar", "Maple", "Oak", "Rowan", "Hazel", "Ivy"]
    texts = []
    for _ in range(120):
        a, b = rng.sample(names, 2)
        texts.append(" ".join(rng.choice([f"Mr {a}", f"Mrs {a} {b}", f"{a}", f"{b.upper()}", f"{a} {b}", "walks", f"{a}s", "in"]) for _ in range(12)))
    for before, after in zip(texts, shown(spark, texts), strict=True):
        told = {w for m in re.findall(r"(?:Mrs|Mr) ([A-Z][a-z]+(?: [A-Z][a-z]+){0,3})", before) for w in m.split()}
        for w in told & set(names):
            assert not re.search(rf"(?<!\w)(?:{w}|{w.upper()})(?!\w)", after), (w, before, after)


def test_every_word_that_only_toxic_documents_have_counts(spark):
    # "stupid" stands beside "idiot" in all but no document of its own.
    rng = random.Random(8)
    plain = [f"{a}{b}" for a in "ba ce di fo gu la me ni po ru".split() for b in "lor men tis rak fen dol".split()]
    prose = lambda: " ".join(rng.choice(plain) for _ in range(rng.randrange(20, 50)))
    rows = [(prose(), 0) for _ in range(300)]
    rows += [(f"{prose()} idiot {prose()}" + (" stupid" if i < 6 else ""), 1) for i in range(25)]
    cues = toxicity.cues(rows)
    assert "=stupid" in cues and "=idiot" in cues and not any(f"={w}" in cues for w in plain)
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)] + [(900, "you are stupid today"), (901, "you are fine today")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(rows)], "_id long, y int")
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, labels).where(F.col("doc_id") >= 900).collect()}
    assert got[900].predicted == 1 and got[901].predicted == 0
