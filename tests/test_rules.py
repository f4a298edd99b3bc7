"""Text rules, ingest rules, checks and streams that the queries do not cover."""

import difflib

import pytest
from pyspark.sql import functions as F

from matchengine.functions import text as T
from matchengine.operators import fields, ingest, merge, offers, pairs, profile, sections, skills
from matchengine.sources import files
from matchengine.streaming import events as S
from tests.test_golden import _stream, each


def test_fold_decomposes(spark):
    got = each(spark, T.fold, ["Łódź Ő Č ñ", "ﬁn ½ Ⅷ ＡＢ", "e\u0301 Straße", "日本 x", None, ""])
    assert got == ["odz o c n", "fin 12 viii ab", "e strae", " x", None, ""]


def test_split_and_odd_ranges(spark):
    cases = {
        "De mai 2020 à\nUTI GROUP Dijon, France\ndéc. 2023": 3, "du janvier 2019 au\nAujourd'hui": 6, "De mai 2020 à\na\nb\nc\ndéc. 2023": 0, "Ingenieur BI Decembre2022 – Mai 2023": 1,
        "Certification obtenue 2020": 0, "Âge : 45 ans, né le 1/1/1980\n7 ans en vente": 7, "+ 12 ans": 12, "expérience de 6 ans": 6,
    }
    assert dict(zip(cases, each(spark, lambda c: fields.years(c, 2025), list(cases)), strict=True)) == cases


def test_hedges(spark):
    cases = {
        "SQL serait un réel plus.": True, "Go constituerait un véritable atout": True, "Rust sera grandement apprécié.": True, "Un atout non négligeable : C": True, "Java is nice to have": True, "De préférence à Lyon": True,
        "Plus de dix ans": False, "Cinq ans d'expérience": False, "": False,
    }
    assert dict(zip(cases, each(spark, sections.is_hedged, list(cases)), strict=True)) == cases


def test_larger_dictionaries_are_joined_by_hash_alike(spark, monkeypatch):
    a = skills.layered(spark.createDataFrame([(0, "A", "the"), (0, "B", "of the"), (1, "C", "the end of it"), (0, "D", "c#")], "layer int, canonical string, alias string"))
    d = spark.createDataFrame([(1, "Of the end; the end of it.", "x"), (2, "c# C#", "The"), (3, None, ""), (4, "nothing", "of  the")], "doc_id long, text string, title string")
    rows = lambda: sorted(map(tuple, skills.find_in_fields(d, a, "doc_id", ("text", "title")).collect()))
    small = rows()
    assert small == [(1, "text", "A", 1, 1), (1, "text", "B", 2, 0), (1, "text", "C", 4, 3), (2, "text", "D", 1, 0), (2, "title", "A", 1, 0), (4, "title", "A", 1, 1), (4, "title", "B", 2, 0)]
    monkeypatch.setattr(skills, "MOST_ALIASES", 2)
    assert rows() == small
    assert skills.find_skills(d, a.limit(0)).count() == 0


def test_whitelist(spark):
    a = skills.layered(spark.createDataFrame([(0, "Python", "python")], "layer int, canonical string, alias string"))
    d = spark.createDataFrame([(1, "stratégie IT du groupe"), (2, "Pyhton et kuberntes"), (3, "docker, git and python"), (4, None)], "doc_id long, text string")
    white = ["git", "python", "kubernetes", "docker"]
    got = sorted(map(tuple, skills.with_whitelist(d, skills.find_skills(d, a), a, white).select("doc_id", "canonical", "n", "pos").collect()))
    assert got == [(2, "Python", 0, 3), (2, "kubernetes", 0, 4), (3, "Python", 1, 3), (3, "docker", 0, 5), (3, "git", 0, 4)]
    words = ["kuberntes", "pyhton", "dokcer", "dock", "it", "docker"]
    w = spark.createDataFrame([(x,) for x in words], "word string")
    want = {(x, t) for t in white if len(t) >= 4 for x in words if difflib.SequenceMatcher(None, x, t).ratio() >= 0.8}
    targets = spark.createDataFrame([(x,) for x in white], "target string")
    assert {(r.word, r.target) for r in skills.resembling(w, targets).collect()} == want


def test_resembling_words_against_all_pairs(spark):
    """Every pair that reaches the cutoff, of which few are compared."""
    import numpy as np

    rng = np.random.default_rng(11)
    stems = ["".join(rng.choice(list("etaoinshrdlucmfwygpbvk"), int(rng.integers(1, 14)))) for _ in range(700)]

    def changed(w):
        w = list(w)
        for _ in range(int(rng.integers(0, 3))):
            at = int(rng.integers(0, len(w) + 1))
            w[at : at + int(rng.integers(0, 2))] = rng.choice(list("aeiou#+."), int(rng.integers(0, 2))).tolist()
        return "".join(w)

    words = sorted({changed(s) for s in stems for _ in range(4)} | {"", "é", "aaaa", "aaaaa"})
    targets = sorted({*stems[:400], *(changed(s) for s in stems[:300]), "aaaaaa", "git", "été1"})
    w, t = spark.createDataFrame([(x,) for x in words], "word string"), spark.createDataFrame([(x,) for x in targets], "target string")
    for cutoff, least in ((0.8, 4), (0.6, 1)):
        want, letters = set(), {x: {c: x.count(c) for c in set(x)} for x in {*words, *targets}}
        for x in words:
            for y in targets:
                if x and len(y) >= least and 2 * sum(min(n, letters[y].get(c, 0)) for c, n in letters[x].items()) >= cutoff * (len(x) + len(y)) and difflib.SequenceMatcher(None, x, y).ratio() >= cutoff:
                    want.add((x, y))
        assert {(r.word, r.target) for r in skills.resembling(w, t, cutoff, least).collect()} == want
    share = skills.candidates(w, t).count() / (len(words) * len(targets))
    print("pairs compared", share)
    assert share < 0.05
    got = {r.word: r.target for r in skills.fuzzy(w, t).collect()}
    for x in words[::37]:
        if len(x) >= 4:
            assert got.get(x) == next(iter(difflib.get_close_matches(x, targets, 1, 0.8)), None)


def test_short_words_do_not_resemble_long_ones(spark):
    w = spark.createDataFrame([("it",), ("is",), ("rest",), ("react",), ("reactt",), ("sap",)], "word string")
    t = spark.createDataFrame([("git",), ("bi",), ("react",), ("sas",), ("rust",)], "target string")
    assert {(r.word, r.target) for r in skills.resembling(w, t).collect()} == {("react", "react"), ("reactt", "react")}


def test_latest_row_of_a_key(spark, tmp_path):
    rows = spark.createDataFrame([(1, "b", 2), (1, "c", 3), (2, "x", None), (None, "n", 1)], "id int, v string, t int")
    assert sorted(merge.latest(rows, ["id"], "t").select("v").toPandas()["v"]) == ["c", "n", "x"]
    assert merge.latest(rows, ["id"]).count() == 3
    stream = _stream(spark, tmp_path, [[(1, "a", 1), (1, "b", 2)], [(1, "d", 4), (1, "c", 3)]], "id int, v string, t int")
    out = str(tmp_path / "t")
    stream.writeStream.foreachBatch(S.upsert_batches(out, ["id"], order="t")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert list(map(tuple, S.upserted(spark, out, "id int, v string, t int").collect())) == [(1, "d", 4)]


def test_pairs_leave_archived_and_failed_documents_out(spark):
    c = spark.createDataFrame([(1, None, None, True), (2, 5, None, True), (3, None, 9, True), (4, None, None, False)], "id int, owner_id int, session_id int, extraction_success boolean")
    j = spark.createDataFrame([(7, 5), (8, 6)], "id int, owner_id int")
    assert sorted(map(tuple, pairs.eligible_pairs(c, j).collect())) == [(1, 7), (1, 8), (2, 7)]
    near = spark.createDataFrame([(7, 1, 1, 0.9), (8, 2, 1, 0.8), (7, 3, 2, 0.7)], "query_id int, id int, rank int, score double")
    assert sorted(map(tuple, pairs.shortlisted(near, c, j).select("cv_id", "job_id").collect())) == [(1, 7)]


def test_checks(spark):
    assert offers.checked("accept", offers.DECISIONS) == "accept" and offers.tuning(0.5, 1.0) == {"threshold": 0.5, "max_credit": 1.0}
    for f in (lambda: offers.checked("maybe", offers.DECISIONS), lambda: offers.tuning(0.0), lambda: offers.tuning(0.5, 1.2)):
        with pytest.raises(ValueError):
            f()
    d = spark.createDataFrame([("maybe",)], "x string")
    with pytest.raises(Exception, match="not allowed: maybe"):
        d.select(offers.checked_column(F.col("x"))).collect()


def test_names_are_resolved_as_far_as_needed(spark):
    have = spark.createDataFrame([("a.pdf", 2), ("a__u1.pdf", None), ("a__u1-2.pdf", 3), ("a__u1-4.pdf", 3), ("b", 1), ("c__u1.txt", 1), ("c.txt", None)], "path string, owner_id long")
    up = spark.createDataFrame([(1, "a.pdf", 1), (2, "b", 1), (3, "c.txt", 1), (4, "new.docx", 1), (5, "b", 2)], "upload_id long, name string, owner_id long")
    got = {r.upload_id: r.path for r in ingest.resolve_names(up, have).collect()}
    assert got == {1: "a__u1-3.pdf", 2: "b", 3: "c__u1.txt", 4: "new.docx", 5: "b__u2"}


def test_history_and_unknown_ids(spark, tmp_path):
    d = spark.createDataFrame([(1,), (2,)], "id int")
    for _ in range(2):
        ingest.append_history(d, str(tmp_path / "h"), 0)
    ingest.append_history(d, str(tmp_path / "h"), 1)
    assert spark.read.parquet(str(tmp_path / "h")).count() == 4
    assert [r.id for r in ingest.unknown(d, spark.createDataFrame([(2,), (3,)], "id int")).collect()] == [3]


def test_folder_watch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/cv.txt").write_bytes(b"one")
    (tmp_path / "in/x.png").write_bytes(b"no")
    q = files.watch(spark, str(tmp_path / "in")).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination()
    (row,) = spark.read.parquet(str(tmp_path / "out")).collect()
    assert row.event_type == "created" and row.path.endswith("cv.txt") and row.fingerprint == "7692c3ad3540bb803c020b3aee66cd8887123234ea0c6e7143c0add73ff431ed"


def test_spans_and_tasks(spark):
    d = spark.createDataFrame([(1, "x@y.fr 12 ans"), (2, None), (3, "")], "doc_id long, text string")
    found = offers.spans(d, patterns={"A": "y.fr 1", "B": r"\S+@\S+", "C": "fr 12 ans"})
    assert [(r.label, r.start, r.end) for r in found.collect()] == [("B", 0, 6)]
    assert offers.annotation_tasks(d, found, 2).count() == 2


def test_small_field_rules(spark):
    name = lambda c: fields.person_name(c, ["curriculum"])
    assert each(spark, name, ["Curriculum Vitae\nHélène Müller\nx", "no name here", None]) == ["Hélène Müller", None, None]
    title = lambda c: fields.job_title(c, ["developpeur", "chef"], ["gerer"])
    assert each(spark, title, ["Gérer un chef\nDéveloppeur Java confirmé", "x"]) == ["Développeur Java confirmé", None]
    a = skills.layered(spark.createDataFrame([(0, "SQL", "sql")], "layer int, canonical string, alias string"))
    j = spark.createDataFrame([(1, "1. sql\n2. MOA\nSQL"), (2, None)], "id long, priority_text string")
    assert [(r.id, r.keywords) for r in profile.priority(j, a).collect()] == [(1, ["SQL", "MOA"])]
    s = spark.createDataFrame([(1, 1, 1, 0.9, 0.5), (1, 2, 2, 0.8, 0.4)], "query_id int, id int, rank int, score double, full_score double")
    assert [(r.score, r.provisional) for r in pairs.provisional_then_final(s, 1).orderBy("id").collect()] == [(0.5, False), (0.8, True)]


def test_csv_file(spark, tmp_path):
    d = spark.createDataFrame([(1, 0.5, ["a", "b"]), (2, 0.9, [])], "id int, score double, keywords array<string>")
    merge.write_csv(d, str(tmp_path / "c"))
    (f,) = (tmp_path / "c").glob("*.csv")
    assert f.read_text(encoding="utf-8").splitlines() == ["\ufeffid,score,keywords", '2,0.9,""', "1,0.5,a; b"]


def test_two_owners_upload_one_name_in_one_batch(spark):
    up = spark.createDataFrame([(1, "cv.pdf", 1, "a"), (2, "cv.pdf", 2, "b"), (3, "cv.pdf", 3, "c"), (4, "cv.pdf", 2, "d"), (5, "cv__u3.pdf", 7, "e"), (6, "old.pdf", 5, None), (7, "old.pdf", 6, "f")], "upload_id long, name string, owner_id long, priority_keywords string")
    have = spark.createDataFrame([("old.pdf", 6, "ready", 1, "kept")], "path string, owner_id long, status string, session_id long, priority_keywords string")
    named = ingest.resolve_names(up, have)
    assert {r.upload_id: r.path for r in named.collect()} == {1: "cv.pdf", 2: "cv__u2.pdf", 3: "cv__u3-2.pdf", 4: "cv__u2.pdf", 5: "cv__u3.pdf", 6: "old__u5.pdf", 7: "old.pdf"}
    got = {(r.path, r.owner_id, r.status, r.priority_keywords) for r in ingest.ingest(have, named).collect()}
    assert got == {("cv.pdf", 1, "pending", "a"), ("cv__u2.pdf", 2, "pending", "d"), ("cv__u3-2.pdf", 3, "pending", "c"), ("cv__u3.pdf", 7, "pending", "e"), ("old__u5.pdf", 5, "pending", None), ("old.pdf", 6, "ready", "f")}


def test_bodies_are_those_of_the_sections(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    own = spark.createDataFrame([(-1, "intro\nFormation\nM2\n \nCompétences requises :\nSQL\nPython\nAtouts\nScala\nF O R M A T I O N\nL3"), (-2, None), (-3, "Formation")], "doc_id long, text string")
    names = ["other", "education", "job_required", "job_nice"]
    every = docs.unionByName(own)
    want = {(r.doc_id, r.section): r.body for r in sections.sectioned(every).collect() if r.section in names}
    got = {(r.doc_id, n): r.b[n] for r in every.select("doc_id", sections.bodies(F.col("text"), names).alias("b")).collect() for n in names if r.b[n] is not None}
    assert got == want and (-1, "education") in got and "M2\nL3" == got[-1, "education"]


def test_sections_of_a_conversion_override_the_text(spark):
    a = spark.createDataFrame([(0, "SQL", "sql"), (0, "Python", "python"), (0, "Scala", "scala")], "layer int, canonical string, alias string")
    text = "Poste\nCompétences requises\nScala"
    rows = [(1, text, {"job_required": " SQL ", "strength": "Python", "_doc_title": "Data Engineer"}), (2, text, None), (3, text, {"_doc_title": "Only a title"}), (4, text, {"job_required": " ", "unheard": "x"})]
    d = spark.createDataFrame(rows, "doc_id long, text string, given map<string,string>")
    for known in (skills.layered(a), skills.compiled(skills.layered(a))):
        got = {r.doc_id: (r.title_line, r.required_skill_terms, r.nice_skill_terms) for r in profile.profiles(d, known, 2025, override="given").collect()}
        assert got[1] == ("Data Engineer", ["SQL"], ["Python"])
        assert got[2] == ("Poste", ["Scala"], [])
        assert got[3] == ("Only a title", ["Scala"], [])
        assert got[4][0] == "Poste" and got[4][1] == ["Scala"]


@pytest.mark.parametrize("most", [200_000, 1])
def test_dictionary_sent_or_joined(spark, monkeypatch, most):
    monkeypatch.setattr(skills, "MOST_ALIASES", most)
    rows = [(0, "Data Science", "data science"), (0, "Data", "data"), (0, "C++", "c++"), (0, "Science", "science"), (0, "Lake", "data lake house"), (1, "Other", "data lake")]
    known = skills.compiled(skills.layered(spark.createDataFrame(rows, "layer int, canonical string, alias string")))
    assert (known.sent is None) == (most == 1)
    d = spark.createDataFrame([(1, "Data lake house, data science; C++"), (2, "databases"), (3, None), (4, ""), (5, "science data\ndata science data")], "doc_id long, text string")
    got = {(r.doc_id, r.canonical, r.n, r.pos) for r in skills.find_skills(d, known).collect()}
    assert got == {(1, "Lake", 3, 0), (1, "Other", 2, 0), (1, "Data", 1, 0), (1, "Data Science", 2, 3), (1, "Science", 1, 4), (1, "C++", 1, 5), (5, "Science", 1, 0), (5, "Data", 1, 1), (5, "Data Science", 2, 2)}
    lists = {r.doc_id: r.found for r in skills.with_lists(d, known, {"text": "found"}, "doc_id").collect()}
    assert lists == {1: ["Lake", "Other", "Data", "Data Science", "Science", "C++"], 2: [], 3: [], 4: [], 5: ["Science", "Data", "Data Science"]}
    none = skills.compiled(spark.createDataFrame([], "alias string, canonical string"))
    assert skills.find_skills(d, none).count() == 0


def test_fold_parts_texts_at_ligatures_only(spark):
    import unicodedata

    some = "".join(map(chr, [*range(0x20, 0x2FFF), *range(0xF900, 0xFFFF), *range(0x1D400, 0x1D800), *range(0x1F100, 0x1F200)])).replace("\x7f", "")
    texts = [some[i : i + 97] for i in range(0, len(some), 97)] + ["plain ASCII", "a’b´c`d"]
    want = [unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower() for t in texts]
    assert each(spark, T.fold, texts) == want
    assert each(spark, lambda c: T.fold(c, quotes=True), ["a’b´c`D", "é’"]) == ["a'b'c'd", "e'"]
