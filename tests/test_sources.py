"""Files, profiles, prompts and reasoning on small fixtures."""

from __future__ import annotations

import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from careerloom.operators import docparse, profile, scorer
from careerloom.sources import files

PROFILE = """# Ann Lee (she/her)
**Builder of things**
Springfield · 3rd connection and more
---
## Experience
**Analyst** — Acme · Part-time
Jan 2024 – Jun 2024 · 6 mos · Springfield, IL · On-site
Built reports.
Skills: sql, git,
---
not part of an entry
**Helper** – Home
2023 · Remote
## Education
**State College** — 2020 – 2024
**Night School** — Course, Trade · Jun 2025 – Aug 2025
Skills: none
## Certifications
| Certification | Issuer | Issued |
|---|---|---|
| Data One | Org | May 2024 · ID: 77 |
| short |
## Projects
**loom** — 2025
A weaver.
GitHub: https://example.org/loom
Skills: wool
## Skills
Technical: sql, git
Soft Skills: care
"""


def test_profile(spark):
    df = spark.createDataFrame([(1, PROFILE), (2, ""), (3, None), (4, "no heading\n**bold**\nplain")], "id int, text string")
    parts = docparse.sections(df, "id", "text").where("id = 1")
    body = {r.title or "": r.body for r in parts.collect()}
    one = spark.createDataFrame([(body[""], body["Experience"], body["Education"], body["Certifications"], body["Projects"], body["Skills"])], "h string, e string, d string, c string, p string, s string")
    got = one.select(profile.header(F.col("h")).alias("h"), profile.experience(F.col("e")).alias("e"), profile.education(F.col("d")).alias("d"), profile.certificates(F.col("c")).alias("c"), profile.projects(F.col("p")).alias("p"), profile.skills(F.col("s")).alias("s")).first()
    assert tuple(got.h) == ("Ann Lee", "she/her", "Builder of things", "Springfield")
    assert [tuple(x) for x in got.e] == [("Analyst", "Acme", "Jan 2024 – Jun 2024 · 6 mos · Springfield, IL · On-site", "Springfield, IL", "Built reports.", ["sql", "git"]), ("Helper", "Home", "2023 · Remote", "Remote", None, None)]
    assert [tuple(x) for x in got.d] == [("State College", None, "2020 – 2024"), ("Night School", "Course, Trade", "Jun 2025 – Aug 2025")]
    assert [tuple(x) for x in got.c] == [("Data One", "Org", "May 2024")]
    assert [tuple(x) for x in got.p] == [("loom", "2025", "A weaver.", "https://example.org/loom", ["wool"])]
    assert tuple(got.s) == (["sql", "git"], ["care"])
    empty = df.where("id > 1").select(profile.header(F.col("text")).alias("h"), profile.experience(F.col("text")).alias("e"), profile.certificates(F.col("text")).alias("c"), profile.skills(F.col("text")).alias("s")).collect()
    assert all(tuple(r.h) == (None,) * 4 and r.e == [] and r.c == [] and tuple(r.s) == (None, None) for r in empty)


def test_files(spark, tmp_path: Path):
    source = tmp_path / "a.bin"
    source.write_bytes(b"x" * 100)
    assert files.download(source.as_uri(), str(tmp_path / "b.bin")) == 100
    with zipfile.ZipFile(tmp_path / "data.zip", "w") as z:
        z.writestr("in/one.csv", "a,b\n1,2\n")
        z.writestr("in/two.txt", "no")
    got = files.read_zip(spark, str(tmp_path / "*.zip"), r".*\.csv").collect()
    assert [(r.member, bytes(r.content)) for r in got] == [("in/one.csv", b"a,b\n1,2\n")]
    rows = spark.createDataFrame([(1, "x & y", 1.5), (2, None, None)], "id int, name string, score double")
    files.write_xlsx(str(tmp_path / "book.xlsx"), {"Summary": rows, "Names": rows.select("name")})
    with pytest.raises(ValueError):
        files.write_xlsx(str(tmp_path / "large.xlsx"), {"All": rows}, most=1)
    got = {(r.source, r.row): r.cells for r in files.read_xlsx(spark, str(tmp_path / "book.xlsx")).collect()}
    assert got == {("Summary", 1): {"id": "1", "name": "x & y", "score": "1.5"}, ("Summary", 2): {"id": "2", "name": None, "score": None}, ("Names", 1): {"name": "x & y"}, ("Names", 2): {"name": None}}
    texts = files.read_documents(spark, str(tmp_path / "*.bin"), lambda raw: raw.decode() if len(raw) == 100 else 1 / 0).collect()
    assert {r.text for r in texts} == {"x" * 100}
    files.write_reports(rows, str(tmp_path / "out"), F.col("id"), F.col("name"), ["name", "score"])
    assert "x &amp; y" in next((tmp_path / "out" / "name=1").glob("*.txt")).read_text()


def test_recent_repositories(spark):
    rows = [("u", f"r{k}", None, ["py"], k, 0, k % 3 == 0, f"2024-01-{k:02}", "z" * 2000) for k in range(1, 15)]
    df = spark.createDataFrame(rows, "user string, name string, description string, languages array<string>, stars int, forks int, fork boolean, updated string, readme string")
    got = files.recent_repositories(df).first().repos
    assert [r.name for r in got] == [f"r{k}" for k in range(14, 4, -1) if k % 3] and {len(r.readme) for r in got} == {1500}


def test_prompts_and_reasoning(spark):
    prompts = scorer.Prompts()
    prompts.add("depth", "Rate {text} from 1 to 5", {"score": (1, 5, 3)})
    df = spark.createDataFrame([("a", '{"score": 9}'), ("b", "no json"), (None, 'so: {"score": 2}')], "t string, answer string")
    got = df.select(prompts.text("depth", text=F.col("t")).alias("p"), prompts.answer("depth", F.col("answer")).alias("a")).collect()
    assert [(r.p, r.a.score) for r in got] == [("Rate a from 1 to 5", 5.0), ("Rate b from 1 to 5", 3.0), ("Rate  from 1 to 5", 2.0)]
    rows = spark.createDataFrame([(1, "GC", "survey"), (1, "EC", None), (2, "RFF", "survey")], "id int, pillar string, source string")
    assert {r.reasoning for r in scorer.reasoned(rows, "id", "pillar", ["EC", "GC"]).collect()} == {"Score derived from survey.", "Score derived from survey+docs."}
    said = scorer.reasoned(rows, "id", "pillar", ["EC", "GC"], lambda row, notes: None if row["pillar"] == "RFF" else f"{row['pillar']} after {len(notes)}").collect()
    assert {(r.id, r.pillar, r.reasoning) for r in said} == {(1, "EC", "EC after 0"), (1, "GC", "GC after 1"), (2, "RFF", "Score derived from survey.")}


def test_clustered_postings_read_few_row_groups(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from careerloom.sources import tables as S

    functions = [f"Func{k}" for k in range(12)]
    k = F.col("id")
    # a third of all rows has one function
    name = F.when(k % 3 == 0, "Func0").otherwise(F.element_at(F.array(*[F.lit(f) for f in functions]), (k % 11 + 2).cast("int")))
    postings = spark.range(6000).select(k.cast("string").alias("id"), name.alias("function"), F.element_at(F.array(*[F.lit(x) for x in ("ENTRY", "senior", "", "Staff")]), (k % 4 + 1).cast("int")).alias("level"), F.when(k % 5 > 0, "us").when(k % 10 == 0, "DE").alias("country_code"))
    postings = postings.union(spark.createDataFrame([("x", None, None, None)], "id string, function string, level string, country_code string"))
    path = str(tmp_path / "corpus")
    S.write_clustered(postings, path, group_rows=50)
    for wanted in (["func3"], ["FUNC0"], ["func5", "func7"], ["none"]):
        want = S.entry_postings(postings, wanted)
        got = S.clustered_entry_postings(spark, path, wanted)
        assert got.columns == postings.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plan = got._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "In(function_key" in plan.split("PushedFilters")[-1] or "EqualTo(function_key" in plan.split("PushedFilters")[-1]
    # row groups whose ranges the filters allow, by the files' own statistics
    read = every = 0
    for f in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            ends = [meta.row_group(g).column(c).statistics for c in range(3)]
            every += 1
            read += ends[0].min <= "func3" <= ends[0].max and any(ends[1].min <= x <= ends[1].max for x in (*S.ENTRY_LEVELS, "")) and any(ends[2].min <= x <= ends[2].max for x in ("US", ""))
    assert every > 100 and read <= every / 10
