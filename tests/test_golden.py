"""Golden cases of text, field, section and scoring functions, and what streams and sinks do."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from matchengine.functions import scoring
from matchengine.functions import text as T
from matchengine.operators import fields, merge, reads, sections
from matchengine.sources import files
from matchengine.streaming import events as S


def each(spark, column, values, kind="string"):
    d = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in d.select("i", column(F.col("x")).alias("y")).orderBy("i").collect()]


def test_years(spark):
    cases = {
        "9 années d'expérience": 9, "5 ans d'expériences": 5, "Expérience: 3 ans": 3, "Minimum 8 ans en développement": 8, "Développeur 2018 - 2023": 5, "Chef de projet 2024 – à ce jour": 1,
        "Data Analyst 2021 – Aujourd’hui": 4, "Depuis 2018 chez Acme": 7, "depuis janvier 2020": 5, "Ingénieur BI 2020 – 2024\nConsultant 2017 – 2020": 7, "Poste A: 2018-2023\nPoste B: 2020-2024": 6,
        "Expérience 2015 au 2020": 5, "De 2019 à 2023": 4, "janvier 2019 - décembre 2023": 4, "01/2019 - 12/2023": 4, "Diplômé en 2015": 0, "Né en 1990": 0, "1960 - 2024": 0,
    }
    assert dict(zip(cases, each(spark, lambda c: fields.years(c, 2025), list(cases)), strict=True)) == cases


def test_section_headings(spark):
    cases = {
        "Expérience": "experience", "Experiences professionnelles": "experience", "Formation": "education", "Formation academique": "education", "Compétences requises": "job_required",
        "Competences techniques": "skills", "C O M P É T E N C E S": "skills", "M A F O R M A T I O N": "education", "C E R T I F I C A T I O N": "certifications",
        "Location de véhicule": None, "Controle de gestion et suivi budgetaire mensuel.": None, "C A R O L E": None, "Jean D a obtenu son diplome": None,
    }
    assert dict(zip(cases, each(spark, sections.section_of, list(cases)), strict=True)) == cases


def test_person_key(spark):
    a, b, c, d, e, f = each(spark, T.person_key, ["Abdelghafour OUENJLI", "ouenjli abdelghafour", "Hélène Müller", "MULLER helene", "Dupont", None])
    assert a == b and c == d and e is None and f is None


def test_keyword_lines(spark):
    got = each(spark, T.keyword_lines, ["Mots Clés :\nChef de projet\n\nMOA / AMOA\n", "1. SQL\n2) Python\n(3) Java\n", "CI/CD\nFull-Stack\n", "Liste des mots-clés :\nSQL\n", "", " \n "])
    assert got == [["Chef de projet", "MOA / AMOA"], ["SQL", "Python", "Java"], ["CI/CD", "Full-Stack"], ["SQL"], [], []]


def test_tokens(spark):
    got = each(spark, T.skill_tokens, ["Maitrise de Qliksense.", "Stack : Node.js et Vue.js", "Developpeur C# et C++"])
    assert got == [["maitrise", "de", "qliksense"], ["stack", "node.js", "et", "vue.js"], ["developpeur", "c#", "et", "c++"]]


def test_experience(spark):
    d = spark.createDataFrame([(3,), (5,), (10,), (11,), (15,), (20,), (50,)], "cv int")
    s = [r[0] for r in d.select("cv", scoring.experience(F.col("cv"), F.lit(5))[0].alias("s")).orderBy("cv").select("s").collect()]
    assert s[:3] == pytest.approx([0.6, 1, 1]) and s[3] > s[4] > s[5] == pytest.approx(0.85) and s[6] == pytest.approx(0.85)


def test_seniority(spark):
    assert each(spark, lambda c: scoring.seniority_years(c, F.lit("")), ["Consultant Expert Décisionnel", "Data Analyst Sénior H/F", "Profil confirmé recherché", "Développeur Junior", "Chef de Projet IT"]) == [8, 5, 3, 1, 0]


def test_eligible(spark):
    d = spark.createDataFrame([(None, None), (None, 5), (5, None), (5, 5), (5, 6)], "a int, b int")
    assert [r[0] for r in d.select(reads.eligible(F.col("a"), F.col("b"))).collect()] == [True, True, True, True, False]


def test_chunks_hold_the_whole_text(spark):
    text = "\n".join(f"line {i} of a rather long text" for i in range(300))
    (got,) = each(spark, T.chunks, [text])
    assert all(len(c) <= 800 for c in got) and "".join("".join(got).split()) == "".join(text.split())


def test_decode_and_docx():
    assert files.decode("é".encode()) == "é" and files.decode("é".encode("cp1252")) == "é"
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    assert files.docx_text(out.getvalue()).split("\n") == ["One", "a\tb"]


def test_scan_and_extract(spark, tmp_path):
    (tmp_path / "cv.txt").write_bytes("Développeur".encode())
    (tmp_path / "old.TXT").write_bytes("Ingénieur".encode("cp1252"))
    (tmp_path / "x.png").write_bytes(b"no")
    (tmp_path / "bad.docx").write_bytes(b"no")
    got = {r.path.rsplit("/", 1)[1]: r.text for r in files.extract(files.scan(spark, str(tmp_path))).collect()}
    assert got["cv.txt"] == "Développeur" and got["bad.docx"] == "" and "x.png" not in got


def test_upsert_keeps_components(spark):
    old = spark.createDataFrame([(1, 10.0, 0.5), (2, 20.0, None)], "id int, score double, score_skills double")
    new = spark.createDataFrame([(1, 11.0, None), (3, 30.0, 0.1)], "id int, score double, score_skills double")
    assert sorted(map(tuple, merge.upsert(old, new, ["id"], ("score_skills",)).select("id", "score", "score_skills").collect())) == [(1, 11.0, 0.5), (2, 20.0, None), (3, 30.0, 0.1)]


def _stream(spark, tmp_path, parts, schema):
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"in/p{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))


def test_leading_edge_stream_agrees_with_batch(spark, tmp_path):
    schema = "event_id long, user_id long, ts timestamp"
    e = spark.createDataFrame([(i, i % 3, 1.7e9 + i * 7) for i in range(60)], "event_id long, user_id long, s double").select("event_id", "user_id", F.col("s").cast("timestamp").alias("ts"))
    rows = sorted(map(tuple, e.collect()))
    stream = S.leading_stream(_stream(spark, tmp_path, [rows[:25], rows[25:]], schema).select("event_id", "user_id", "ts"), ["user_id"], 50)
    out = str(tmp_path / "out")
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out)
    q.awaitTermination()
    want = sorted(map(tuple, S.leading(e, ["user_id"], 50).select("user_id", "event_id").collect()))
    assert sorted(map(tuple, spark.read.parquet(out).select("user_id", "event_id").collect())) == want


def test_upsert_stream(spark, tmp_path):
    schema = "id int, v string"
    stream = _stream(spark, tmp_path, [[(1, "a"), (2, "a")], [(2, "b"), (3, None)]], schema)
    table = str(tmp_path / "t")
    stream.writeStream.foreachBatch(S.upsert_batches(table, ["id"])).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, S.upserted(spark, table, schema).collect())) == [(1, "a"), (2, "b"), (3, None)]


def test_retries_then_dead_letter():
    seen, dead = [], []

    def work(df, batch):
        seen.append(batch)
        raise ValueError("no")

    S.with_dead_letters(work)(None, 4, lambda df, b, e: dead.append((b, str(e))))
    assert seen == [4] * 4 and dead == [(4, "no")] and S.attempts() == [0.5, 1.0, 2.0]
