import random
import re

from pyspark.sql import functions as F

from hirelake.operators.profiles import (
    changed_only, explicit_years, extract_keywords, extract_skills, extract_titles, parse_profiles, refresh_profiles, work_years,
)


def test_skills(value):
    texts = ["JavaScript and Go, R.", "golang", "c++ and C#", "uses SQL; nosql", "", None]
    assert value(extract_skills, texts) == [
        ["go", "java", "javascript", "r"], ["golang"], [], ["nosql", "sql"], [], []]


def test_explicit_years(value):
    texts = ["5+ years of professional experience", "7 years in tech, 3 years of experience", "Experience: 4 years", "nothing 2020", None]
    assert value(explicit_years, texts) == [5, 3, 4, None, None]


def test_work_years_cases(value):
    texts = [
        "EXPERIENCE\nFirm, Engineer\nJan 2021 - March 2025", "EXPERIENCE\nFirm 2021 – Present", "Work\nA 2021-2023\nB 2022 — 2025",
        "EDUCATION\nSchool 2010 - 2014", "Education\nX 2010 - 2014\nWORK\nY 2015-2016", "Work\nsummer intern at a firm, doing all sorts of things there\nA 2015-2016",
        "A 1980 - 1999", "A 2030 - 2031", "A 2020 - 2010", "no dates", "", None, "W\n  A 2000-2001\r\nB 2001-2003, 2010-2011",
    ]
    assert value(lambda c: work_years(c, 2026), texts) == [4, 5, 4, None, 1, None, None, None, None, None, None, None, 4]


def test_work_years_equals_a_walk_over_random_texts(value):
    parts = ["WORK HISTORY", "Education and more", "Firm A", "intern role somewhere on a rather long line that is no header at all 2001",
             "an intern", "x 2000 - 2003", "y March 2002 - 2008", "z 2010-now", "B 1995 – 1997 and 2020 - 2021", "", "a line of some forty-five letters, no header!",
             "project list with a rather long title, fifty char"]
    rng = random.Random(11)
    texts = ["\n".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(400)]
    section = re.compile(r"education|intern|project", re.I)

    def walk(text):
        years, skipping = set(), False
        for line in text.split("\n"):
            header = line and len(line) < 60 and not re.search(r"\d{4}", line)
            if (header and section.search(line)) or re.search(r"\bintern\b", line, re.I):
                skipping = True
            elif header and len(line) < 40:
                skipping = False
            if not skipping:
                for a, b in re.findall(r"(\d{4})\s*[-–]+\s*(?:\w+ )?(\d{4}|now)", line):
                    years |= set(range(int(a), 2026 if b == "now" else int(b)))
        return len(years) or None

    assert value(lambda c: work_years(c, 2026), texts) == [walk(t) for t in texts]


def test_titles_and_keywords(value):
    text = "Senior Software Engineer II, data  scientist; DevOps engineer. Full-Stack developer"
    assert value(extract_titles, text) == ["DevOps engineer", "Full-Stack developer", "Senior Software Engineer II", "data  scientist"]
    assert value(extract_keywords, "The Acme Corp and For It Spark Streaming. Élan. The") == ["For It Spark Streaming", "The Acme Corp"]


def test_parse_profiles(spark):
    df = spark.createDataFrame([(1, "Python\nFirm 2020-2022"), (2, "  "), (3, "8 years of experience\nFirm 2020-2022")], "profile_id int, raw_text string")
    one, two, three = parse_profiles(df, 2026, fallback_skills=["SQL"]).orderBy("profile_id").collect()
    assert (one.skills, one.yoe, one.parser_version) == (["python"], 2, 2)
    assert (two.skills, two.yoe, two.keywords, two.job_titles) == (["SQL"], None, [], [])
    assert three.yoe == 8 and len(three.text_hash) == 32
    plan = parse_profiles(df, 2026)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_changed_only(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d")], "profile_id int, raw_text string")
    cache = df.select("profile_id", F.md5(F.when(F.col("profile_id") == 2, "old").otherwise(F.col("raw_text"))).alias("text_hash"),
                      F.when(F.col("profile_id") == 3, 1).otherwise(2).alias("parser_version")).where("profile_id < 4")
    assert {r.profile_id for r in changed_only(df, cache).collect()} == {2, 3, 4}


def test_refresh_profiles(spark):
    old = spark.createDataFrame([(1, "Python"), (2, "Go"), (9, "Rust")], "profile_id int, raw_text string")
    cache = parse_profiles(old, 2026)
    known = cache.withColumn("yoe", F.lit(-1))
    df = spark.createDataFrame([(1, "Python"), (2, "Go, SQL"), (3, "Java")], "profile_id int, raw_text string")
    merged = {r.profile_id: (r.raw_text, r.skills, r.yoe) for r in refresh_profiles(df, known, 2026).collect()}
    assert merged == {1: ("Python", ["python"], -1), 2: ("Go, SQL", ["go", "sql"], None), 3: ("Java", ["java"], None), 9: ("Rust", ["rust"], -1)}
    assert refresh_profiles(df, cache.where("profile_id < 0"), 2026).count() == 3
    aged = known.withColumn("parser_version", F.lit(1))
    assert {r.yoe for r in refresh_profiles(df.where("profile_id = 1"), aged, 2026).where("profile_id = 1").collect()} == {None}


def test_work_years_edges_and_one_search_a_line(value):
    """lines are neither stripped by a pattern nor searched twice for their ranges."""
    blank = "\x1f \xa0"
    texts = [
        f"{blank}Education{blank}\nX 2010 - 2014\n{blank}Work{blank}\nY 2015-2016", "A" * 60 + "\n" + "education" + "x" * 60 + "\nX 2010-2012",
        "Work\nMarch 2010 - 2012, 2011 – now", "internal\nX 2001-2002", "An INTERN.\nX 2001-2002", "re-intern\nX 2001-2002", "X 2001 - 2001",
        "X 12001 - 20031", "١٩٩٩ education\nX 2001-2002", "X 2001 -–— Sep 2003", "X 2001 - Present 2003-2004",
    ]
    assert value(lambda c: work_years(c, 2026), texts) == [1, 2, 16, None, None, None, 0, 2, 1, 2, 25]
    assert value(lambda c: work_years(c, 2080), "X 1991 - 2070\nY 2075 - now") == 84
    made = str(work_years(F.col("x"), 2026))
    assert "regexp_replace" not in made and made.count("regexp_extract_all") == 1
