from pyspark.sql import functions as F

from docketry.functions import text as X
from docketry.operators import classify as C, intake as I, rules as R, triage as T
from docketry.sources import fixed, loaders


def one(frame, value, expr):
    return frame([(value,)], "t string").select(expr(F.col("t")).alias("v")).first().v


def test_folds(frame):
    assert one(frame, "İŞYERİ", X.loose_fold) == "isyeri"
    assert one(frame, "İkamet", X.loose_fold) == "ikamet"
    assert one(frame, "Straße", X.casefold) == "strasse"
    assert one(frame, "Saat 02.00'de gürültü!", X.letter_tokens) == ["saat", "de", "gurultu"]
    assert one(frame, "3071 sayılı Kanun kapsamında", lambda c: X.tokenize_tr(c, fixed.STOPWORDS)) == ["3071"]


def test_normalize_composes_and_drops_controls(frame):
    assert one(frame, "Şikayet\r\nvar​\u0007\tx\r", X.normalize_text) == "Şikayet\nvar\tx\n"


def test_length_gate_boundary(frame):
    rows = frame([("a" * 39,), ("a" * 40,), ("a" * 41,), (" " * 50,)], "normalized_text string")
    assert sorted(len(r[0]) for r in I.length_gate(rows).collect()) == [40, 41]


def test_text_issues(frame):
    assert one(frame, " ", I.text_issues) == ["empty"]
    assert one(frame, "1 2 3", I.text_issues) == ["below_minimum", "no_words"]
    assert one(frame, "kelime " * 3000, I.text_issues) == ["above_maximum"]


def test_language(frame):
    rows = frame([("Bu dilekçe için gereğini arz ederim",), ("The street and the lamp are broken",), ("12345",), (None,), ("Kadıköy Street is on the map",), ("the ve",)], "normalized_text string")
    found = [r.language for r in I.detect_language(rows).collect()]
    assert found == ["tr", "en", "unknown", "unknown", "en", "unknown"]


def test_title(frame):
    text = "Belediye Başkanlığına,\nMahallemizde her gece gürültü oluyor. Gereğini arz ederim."
    assert one(frame, text, I.derive_title) == "Mahallemizde her gece gürültü oluyor."
    assert one(frame, "x" * 200, I.derive_title) == "x" * 87 + "…"
    assert one(frame, " ", I.derive_title) == "Vatandaş dilekçesi"


def tiny_taxonomy(spark, frame, signals, keywords=()):
    return {
        "departments": frame([("d", "D", True)], "department_id string, department_label string, active boolean"),
        "units": frame([("u", "U", "d", True)], "unit_id string, unit_label string, department_id string, active boolean"),
        "request_types": frame([(0, "a", "Type A", "u", "v"), (1, "b", "Type B", "u", "v")], "type_ord int, request_type_id string, request_type_label string, unit_id string, taxonomy_version string"),
        "keywords": frame(list(keywords) or [("a", "tr", 0, "x")], "request_type_id string, language string, keyword_ord int, keyword string"),
        "signals": frame(signals, "request_type_id string, language string, group_ord int, form_ord int, form string"),
    }


def test_signal_matching_rules(spark, frame):
    signals = [("a", "tr", 0, 0, "gece$"), ("a", "tr", 1, 0, "ses"), ("a", "tr", 2, 0, "gurultu"), ("a", "tr", 3, 0, "yerlesim yeri")]
    tax = tiny_taxonomy(spark, frame, signals)
    texts = ["Geçen ay başvurdum", "Her gece tekrarlanıyor", "Sesler geliyor", "Ses çok yüksek", "Gürültüden bıktık", "Yerleşim yeri adresim"]
    docs = frame([(n, t) for n, t in enumerate(texts)], "id int, normalized_text string")
    got = {r.id: r.matched for r in C.classify_semantic(docs, tax).collect()}
    assert [got[n] for n in range(6)] == [[], ["gece$"], [], ["ses"], ["gurultu"], ["yerlesim yeri"]]


def test_signal_ranking_uses_uncapped_ratio(spark, frame):
    signals = [("a", "en", g, 0, w) for g, w in enumerate(("alpha", "beta", "gamma"))] + [("b", "en", g, 0, w) for g, w in enumerate(("alpha", "beta", "gamma", "delta"))]
    docs = frame([("alpha beta gamma delta",)], "normalized_text string")
    row = C.classify_semantic(docs, tiny_taxonomy(spark, frame, signals)).first()
    assert (row.request_type_id, row.confidence, row.runner_up_label, row.runner_up_score, row.status) == ("b", 1.0, "Type A", 1.0, "classified")


def test_keyword_ties_prefer_tr_and_smaller_id(spark, frame):
    words = [(t, lang, 0, "word") for t in ("b", "a") for lang in ("en", "tr")]
    row = C.classify_keyword(frame([("a word here",)], "normalized_text string"), tiny_taxonomy(spark, frame, [("a", "tr", 0, 0, "x")], words)).first()
    assert (row.request_type_id, row.keyword_language) == ("a", "tr")


def test_status_boundary(frame):
    rows = frame([(0.799,), (0.8,), (0.801,)], "s double").select(C.status_for_score(F.col("s")).alias("v")).collect()
    assert [r.v for r in rows] == ["needs_review", "needs_review", "classified"]


def test_default_taxonomy_and_registry_are_sound(spark):
    assert loaders.taxonomy_violations(loaders.default_taxonomy(spark)).count() == 0
    assert loaders.registry_violations(loaders.default_registry(spark)).count() == 0


def test_taxonomy_file_forms(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text('{"taxonomyVersion":"v","departments":[{"id":"d","label":"D"}],"units":[{"id":"u","label":"U","departmentId":"d"}],'
                    '"requestTypes":[{"id":"a","label":"A","unitId":"u","keywords":["x","y"]},{"id":"b","label":"B","unitId":"u","keywords":{"en":["z"]},"signals":{"en":[["p","q"],"r"]}}]}')
    tax = loaders.load_taxonomy(spark, str(path))
    words = {(r.request_type_id, r.language, r.keyword) for r in tax["keywords"].collect()}
    assert words == {("a", "tr", "x"), ("a", "tr", "y"), ("b", "en", "z")}
    forms = {(r.request_type_id, r.language, r.group_ord, r.form_ord, r.form) for r in tax["signals"].collect()}
    assert forms == {("a", "tr", 0, 0, "x"), ("a", "tr", 1, 0, "y"), ("b", "en", 0, 0, "p"), ("b", "en", 0, 1, "q"), ("b", "en", 1, 0, "r")}


def test_document_rules(frame):
    docs = frame([("Sayın yetkili, talep ve destek istiyorum",), ("şikayet: sorun ve arıza var",), (" ",), ("zzz",)], "text string")
    got = [(r.document_type, round(r.document_type_score, 2)) for r in R.score_document_type(docs).collect()]
    # Half-even coverage: 2/11 -> 0.18 plus 0.10; 3/15 -> 0.20 plus 0.15.
    assert got == [("dilekçe", 0.28), ("şikayet", 0.35), ("dilekçe", 0.0), ("dilekçe", 0.0)]


def test_half_even_coverage(frame):
    # One of eight keywords: 0.125 rounds to the even neighbour.
    row = R.score_document_type(frame([("katılım",)], "text string")).first()
    assert (row.document_type, row.document_type_score) == ("başvuru_formu", 0.12)


def test_priority(frame):
    texts = [("Gaz kaçağı ve su baskını var",), ("Su baskını oldu",), ("Merhaba",), (None,)]
    got = [(r.priority_level, r.priority_score) for r in T.with_priority(frame(texts, "text string")).collect()]
    assert got == [("critical", 100), ("high", 70), ("normal", 40), ("normal", 40)]


def test_behavior(frame):
    rows = [("Ne demek böyle ulan, ben sıkıldım artık", "tr", 1), ("The skill of the team", "en", 2), ("This threat and violence are unacceptable", "en", 3),
            ("This threat", "tr", 0), ("you will pay for it", None, 0), ("you will payback", None, 0), (None, None, 0)]
    got = T.behavior_signals(frame(rows, "text string, l string, r int"), "text", "l", F.col("r")).collect()
    assert [(r.aggression_score, r.aggression_level, r.marker_count) for r in got] == [
        (0.7, "high", 2), (0.0, "normal", 0), (1.0, "high", 3), (0.0, "normal", 0), (0.7, "high", 1), (0.0, "normal", 0), (0.0, "normal", 0)]
    assert [r.priority_mode for r in got] == [True, False, True, False, True, False, False]
