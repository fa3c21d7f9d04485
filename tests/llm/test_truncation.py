import random

from pyspark.sql import functions as F

from plumbline.llm.truncation import _closing, closing_features, field_limits, fit_closing

NOUNS = ["pump", "valve", "bearing", "gearbox", "strainer", "exciter", "governor", "coupling"]
PLACES = ["Norvik", "Ostrum", "Calderay", "Wrenfoss", "Umberlea"]


def sentence(r):
    return r.choice(
        [
            f"The {r.choice(NOUNS)} at {r.choice(PLACES)} ran without fault until {r.randint(10, 23)}:{r.randint(10, 59)}.",
            f"On 2023-0{r.randint(1, 9)}-1{r.randint(0, 9)} the crew cleaned the {r.choice(NOUNS)} and the reading returned to {r.randint(1, 99)}.{r.randint(0, 9)} kPa.",
            f"Inspection of the {r.choice(NOUNS)} found wear over a length of {r.randint(1, 99)} mm.",
            f"{r.choice(PLACES)}电厂的{r.choice(['水泵', '阀门', '轴承'])}自2022-0{r.randint(1, 9)}-11起投入运行，期间振动正常。",
        ]
    )


def label(r):
    return r.choice([f"Reading 1{r.randint(0, 9)}:{r.randint(10, 59)}: {r.randint(1, 999)} kPa", f"Tag HX-{r.randint(1, 9)}A-{r.randint(100, 999)} / unit {r.randint(1, 90)} / {r.choice(PLACES)}"])


def test_held_out_accuracy(spark):
    r = random.Random(5)
    rows = [(i, " ".join(sentence(r) for _ in range(r.randint(1, 4))), 0) if r.random() < 0.8 else (i, label(r), 0) for i in range(1500)]
    held = []
    for i in range(400):
        text = " ".join(sentence(r) for _ in range(r.randint(1, 4)))
        at = r.randint(6, len(text) - 3)
        part = text[:at].rstrip()
        if part[-1] in ".。" or (part[-1].isdigit() and text[at : at + 1] in ".。"):
            continue
        held.append((10_000 + i, part + r.choice(["", "", "", "…", " [cut]"]), 1))
    frame = spark.createDataFrame(rows + held, "id bigint, text string, cut int")
    scored = fit_closing(frame, "text").score(frame, "text").collect()
    right = sum((s.cut_probability >= 0.5) == bool(s.cut) for s in scored)
    assert right / len(scored) > 0.96
    false = [s.text for s in scored if s.cut_probability >= 0.5 and not s.cut]
    assert len(false) <= 0.01 * len(rows), false[:5]


def test_edge_rows(spark):
    frame = spark.createDataFrame([(1, None), (2, ""), (3, " \n​"), (4, "x" * 300_000)], "features bigint, text string")
    model = fit_closing(frame, "text")
    assert all(r.cut_probability == 0.0 for r in model.score(frame, "text").collect())
    assert fit_closing(frame.limit(0), "text").score(frame.limit(0), "text").count() == 0
    assert closing_features(frame, "text", {"": [240]}, name="made").where("text is not null").select("made").count() == 3


def test_the_last_sentence_is_looked_at_whole(spark):
    long = "Firstly " + "the crew moved the pump and " * 20 + "then the valve was"
    row = spark.createDataFrame([("All was well. " + long,)], "text string").select(_closing(F.col("text")).alias("c")).first().c
    assert len(long) > 500 and row.words[0] == "firstly" and len(row.words) == len(long.split())


def test_every_limit_of_every_source(spark):
    """A length is a limit of the source that cuts there, however many limits there are."""
    rows = [(s, "x" * (n - 1) + "e") for s, ns in (("a", range(100, 160, 3)), ("b", range(300, 340))) for n in ns for _ in range(30)]
    rows += [(s, "x" * n + ".") for s in "abc" for n in range(60, 400)] * 2
    limits, texts = field_limits(spark.createDataFrame(rows, "source string, text string"), "text", "source")
    assert limits == {"a": list(range(100, 160, 3)), "b": list(range(300, 340))} and texts == len(rows)
