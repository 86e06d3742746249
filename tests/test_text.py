import json

import pytest
from pyspark.sql import functions as F

from plumbline.config import Config, load_config
from plumbline.functions import labels as lab
from plumbline.functions import text
from plumbline.operators import rooms
from plumbline.plans import labelling, viewer


def replies(spark, *documents):
    rows = [(i, d if isinstance(d, str) else json.dumps(d)) for i, d in enumerate(documents)]
    return spark.createDataFrame(rows, "frame_idx int, raw string")


def parsed(spark, objects, **options):
    return [r.asDict() for r in text.parse_replies(replies(spark, {"objects": objects}), **options).orderBy("position").collect()]


SIDES = {"whole": [5, 6, 700, 800], "words": ["11", " 12.5", "13.5", "14"], "halves": [0.5, 1.5, 2.5, 3.5]}
BAD_SIDES = [[], [1, 2], [1, 2, 3, 4, 5], ["left", 2, 3, 4], [None, 2, 3, 4], ["Infinity", 2, 3, 4], [1e300, 2, 3, 4], ["NaN", 2, 3, 4], None]


@pytest.mark.parametrize("name", SIDES)
def test_sides_round_half_to_even(spark, name):
    got = parsed(spark, [{"label": "vase", "box_2d": SIDES[name]}])
    assert got[0]["box_2d"] == [round(float(v)) for v in SIDES[name]]


def test_unusable_entries_leave_the_others(spark):
    bad = [{"label": f"bad{i}", "box_2d": sides} for i, sides in enumerate(BAD_SIDES)]
    bad += [{"box_2d": SIDES["whole"]}, {"label": "", "box_2d": SIDES["whole"]}]
    got = parsed(spark, [x for b in bad for x in (b, {"label": "rug", "box_2d": SIDES["whole"]})])
    assert [r["label"] for r in got] == ["rug"] * len(bad)
    assert [r["position"] for r in got] == list(range(1, 2 * len(bad), 2))


@pytest.mark.parametrize("given, want", [(None, 0.5), (0.25, 0.25), (1.75, 1.0), (-3, 0.0), ("0.125", 0.125), ("high", 0.5)])
def test_confidence_is_clipped_or_assumed(spark, given, want):
    entry = {"label": "\tfloor lamp \n", "box_2d": SIDES["whole"], "mask": ""} | ({} if given is None else {"confidence": given})
    got = parsed(spark, [entry])[0]
    assert (got["confidence"], got["label"], got["mask_b64"]) == (want, "floor lamp", None)


def test_replies_that_are_no_json(spark):
    fine = {"objects": [{"label": "rug", "box_2d": SIDES["whole"]}]}
    assert parsed(spark, []) == [] and text.parse_replies(replies(spark, "{}")).count() == 0
    with pytest.raises(Exception, match="not valid JSON"):
        text.parse_replies(replies(spark, "sorry", fine)).collect()
    assert text.parse_replies(replies(spark, "sorry", fine), on_bad_json="skip").count() == 1


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_text_helpers(spark):
    names = [text.strip_model_prefix(F.lit(n)) for n in ("models/google/x", " GEMINI/x ", "x/models/", "bare")]
    assert one(spark, *names) == ("x", "x", "x/models/", "bare")
    stages = [text.log_stage(F.lit(l)) for l in ("  [detect] 3", "[frames] a", "no [label]", "[run] x")]
    assert one(spark, *stages) == ("detect", None, None, None)
    assert one(spark, text.is_progress_bar(F.lit("  4%|#")), text.is_progress_bar(F.lit("50 % done"))) == (True, False)
    cuts = [text.truncation_problem(F.lit(r), m) for r, m in (("MAX_TOKENS", True), ("finish.max_tokens", False), ("STOP", True))]
    masks, bare, fine = one(spark, *cuts)
    assert "masks" in masks and "limit" in bare and fine is None
    assert one(spark, text.object_id(F.lit(7)), text.stage_index(F.lit("detect")), text.stage_index(F.lit("x"))) == ("obj_007", 2, -1)


def test_label_rules(spark):
    """Compatible are labels that are equal once normalised, or of one built-in group."""
    forms = ["wall_clock", "Wall  Clock", " wall clock\t", "wall\u00a0clock"]
    same = [lab.compatible(F.lit(a), F.lit(b)) for a in forms for b in forms]
    assert all(one(spark, *same))
    other = [lab.compatible(F.lit(a), F.lit(b)) for a, b in (("wall clock", "wall"), ("rug", "vase"), ("", "rug"))]
    assert not any(one(spark, *other))


@pytest.mark.parametrize("votes", [{"rug": 3, "mat": 2}, {"mat": 2, "rug": 2, "carpet": 1}, {"Vase": 1}, {"b": 1, "aa": 1, "ab": 1}])
def test_the_most_frequent_label_wins(spark, votes):
    df = spark.createDataFrame([("k", name) for name, n in votes.items() for _ in range(n)], "k string, label string")
    got = lab.pick_labels(df, ["k"], "label").first()
    most = max(votes.values())
    assert votes.get(got["label"], votes.get(got["label"].capitalize())) == most
    assert got["label"].lower() == min((n.lower() for n, c in votes.items() if c == most), key=lambda n: (len(n), n))
    assert sorted(got["aliases"]) == sorted(n.lower() for n in votes if n.lower() != got["label"].lower())


def test_synonym_groups(spark):
    words = ["rug", "mat", "carpet", "vase", "flower vase", "clock"]
    groups = [
        {"canonical": "Floor covering", "labels": ["carpet", "RUG", "mat", "tile"]},
        {"canonical": "flower_vase", "labels": ["vase", "flower vase", "rug"]},
        {"canonical": "lamp", "labels": ["lamp"]}, {"canonical": "x", "labels": None},
    ]
    reply = "Here you are:\n```json\n" + json.dumps({"groups": groups}) + "\n```"
    names = spark.createDataFrame([(w,) for w in words], "label string")
    want = {"rug": "mat", "mat": "mat", "carpet": "mat", "vase": "flower vase", "flower vase": "flower vase", "clock": "clock"}
    assert {r["label"]: r["canonical"] for r in labelling.synonym_table(names, reply).collect()} == want
    with pytest.raises(ValueError):
        labelling.synonym_table(names, "no groups today")
    seen = spark.createDataFrame([(w,) for w in [*words, "", "  "]], "label string")
    asked = []
    assert labelling.resolve_synonyms(seen, lambda p: asked.append(p) or reply) == want
    assert len(asked) == 1 and "- flower vase" in asked[0]
    assert labelling.resolve_synonyms(seen, None) == {} and labelling.resolve_synonyms(seen, lambda p: "?") == {}


def test_objects_sort_by_number(spark):
    ids = spark.createDataFrame([("r", f"obj_{i:03d}") for i in (2, 1000, 101, 7, 999)] + [("r", "other")], "room string, object_id string")
    got = rooms.with_display_position(ids).orderBy("position").collect()
    assert [r["object_id"] for r in got] == ["other", "obj_002", "obj_007", "obj_101", "obj_999", "obj_1000"]


def test_config(tmp_path):
    assert load_config() == Config()
    path = tmp_path / "c.yaml"
    path.write_text("label:\n  max_frames: 3\n")
    assert load_config(path).label.max_frames == 3 and load_config(path).frames.n_frames == 24
    path.write_text("label:\n  nope: 3\n")
    with pytest.raises(ValueError, match="nope"):
        load_config(path)


def test_request_checks(tmp_path):
    labelling.check_range("x", 1, 1, 2)
    with pytest.raises(ValueError):
        labelling.check_range("x", 3, 1, 2)
    (tmp_path / "project").mkdir()
    root = str(tmp_path / "project")
    assert viewer.inside(root, "a/b").startswith(root)
    for bad in ("../other", "../project2/x", "/etc/passwd"):
        with pytest.raises(ValueError):
            viewer.inside(root, bad)
