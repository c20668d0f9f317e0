"""Pairs, boundaries, extraction, readers and the scoring plan."""

import json

import pytest
from pyspark.sql import functions as F

from pairlens.functions.numeric import general_format
from pairlens.functions.text import character_ids, split_lines, text_hash
from pairlens.operators import pairs
from pairlens.plans.score_file import score_file
from pairlens.session import fits_broadcast
from pairlens.sources.tables import parse_pairs, read_pairs

MESSAGES = "array<struct<role string, content string>>"


def messages(prompt, response, roles=("user", "assistant")):
    return [{"role": roles[0], "content": prompt}, {"role": roles[1], "content": response}]


def test_pair_rules_in_order(spark):
    good = messages("p", "c"), messages("p", "r")
    cases = [
        (good, None),
        ((None, good[1]), "not_message_lists"),
        ((good[0][:1], good[1]), "message_count"),
        ((messages("p", "c", ("system", "assistant")), good[1]), "roles"),
        ((messages("", "c"), good[1]), "empty_prompt"),
        ((messages(None, "c"), messages(None, "r")), "empty_prompt"),
        ((good[0], messages("other", "r")), "prompts_differ"),
        ((messages("p", ""), good[1]), "empty_chosen"),
        ((good[0], messages("p", None)), "empty_rejected"),
        (([None, None], good[1]), "roles"),
    ]
    rows = [(i, *case[0]) for i, case in enumerate(cases)]
    df = spark.createDataFrame(rows, f"i int, chosen {MESSAGES}, rejected {MESSAGES}")
    got = {r.i: r.reason for r in pairs.validate_pairs(df).collect()}
    assert got == {i: case[1] for i, case in enumerate(cases)}
    kept = pairs.good_rows(pairs.validate_pairs(df)).collect()
    assert [(r.prompt, r.chosen_text, r.rejected_text) for r in kept] == [("p", "c", "r")]


def encode(spark, prompt, full, limit=100):
    df = spark.createDataFrame([(prompt, full)], "prompt_text string, full_render string")
    return pairs.encode_boundary(df, character_ids, "<eos>", 999, limit).first()


def test_boundary(spark):
    prompt = "USER:x\nASSISTANT:"
    row = encode(spark, prompt, prompt + "ok<eos>\n\n")
    assert row.reason is None and row.full_text == prompt + "ok<eos>"
    assert row.input_ids[-1] == 999
    assert row.input_ids[:-1] == [ord(c) for c in row.full_text[:-1]]
    assert (row.prompt_length, row.response_length) == (len(prompt), 7)
    assert encode(spark, prompt, prompt + "ok").full_text == prompt + "ok <eos>"
    assert encode(spark, prompt, "X" + prompt).reason == "prompt_prefix"
    assert encode(spark, prompt, prompt + "ok<eos>\n", 22).reason == "sequence_too_long"
    assert encode(spark, prompt, prompt + "ok<eos>\n", 19).reason == "prompt_too_long"
    assert encode(spark, prompt, prompt + "ok<eos>\n", len(prompt) + 7).reason is None
    with pytest.raises(ValueError):
        encode(spark, prompt, prompt, 2)


def test_logprob_extraction(spark):
    inf = float("inf")
    cases = [
        ([None, {11: -9.0}, {12: -1.5}, {13: -2.0}], -3.5, None),
        ([None, {11: -9.0}, {12: -1.5}, {99: -2.0}], None, "missing_token"),
        ([None, {11: -9.0}, {12: -1.5}, None], None, "missing_token"),
        ([None, {11: -9.0}, {12: -1.5}], None, "misaligned"),
        (None, None, "misaligned"),
        ([None, {11: -9.0}, {12: -inf}, {13: -2.0}], None, "nonfinite"),
    ]
    rows = [(i, [10, 11, 12, 13], 2, case[0]) for i, case in enumerate(cases)]
    schema = "i int, input_ids array<int>, prompt_length int, prompt_logprobs array<map<int,double>>"
    got = pairs.response_logprob(spark.createDataFrame(rows, schema)).collect()
    assert {r.i: (r.logprob, r.reason) for r in got} == {
        i: case[1:] for i, case in enumerate(cases)
    }


def test_json_lines(spark, tmp_path):
    good = {"row_id": 7, "chosen": messages("p", "c"), "rejected": messages("p", "r")}
    number = {"chosen": messages("p", 5), "rejected": messages("p", "r")}
    lines = [json.dumps(good), "", "  ", "[1]", "{bad", json.dumps(number), json.dumps({"chosen": 1})]
    path = tmp_path / "pairs.jsonl"
    path.write_text("\n".join(lines))
    found = pairs.validate_pairs(read_pairs(spark, str(path))).collect()
    assert len(found) == 5
    by_reason = sorted((r.parse_reason or "", r.reason or "") for r in found)
    assert by_reason == [
        ("", ""),
        ("", "empty_chosen"),
        ("", "not_message_lists"),
        ("not_json", "not_message_lists"),
        ("not_object", "not_message_lists"),
    ]
    assert [r.row_id for r in found if r.reason is None] == ["7"]
    (tmp_path / "empty.jsonl").write_text("\n \n")
    with pytest.raises(ValueError, match="found no line"):
        read_pairs(spark, str(tmp_path / "empty.jsonl"))


def render(prompt, response):
    head = F.concat(F.lit("U:"), prompt, F.lit("\nA:"))
    return head, F.concat(head, response, F.lit("<eos>\n"))


def model(shift):
    def run(batch):
        return [[{token: -float(shift + pos)} for pos, token in enumerate(ids)] for ids in batch]

    return run


def test_score_file_keeps_repeated_rows(spark):
    line = json.dumps({"chosen": messages("p", "cc"), "rejected": messages("p", "r")})
    lines = spark.createDataFrame([(line,), (line,)], "value string")
    models = {"base": model(0), "x": model(1)}
    rows = score_file(parse_pairs(lines), models, render, character_ids, "<eos>", 9).collect()
    assert len(rows) == 2
    head = len("U:p\nA:")
    assert rows[0].prompt_tokens == head
    assert rows[0].base_chosen_logprob == -sum(range(head, head + 7))
    assert rows[0].x_chosen_logprob == -sum(range(head + 1, head + 8))
    assert rows[0].delta_sum_x == -7.0 + 6.0
    assert "chosen_text" not in rows[0].asDict()


def test_score_file_refuses_or_drops_bad_pairs(spark):
    good = json.dumps({"chosen": messages("p", "c"), "rejected": messages("p", "r")})
    bad = json.dumps({"chosen": messages("p", "c"), "rejected": messages("q", "r")})
    long = json.dumps({"chosen": messages("p", "c" * 50), "rejected": messages("p", "r")})
    lines = spark.createDataFrame([(good,), (bad,), (long,), ("{",)], "value string")
    args = ({"base": model(0)}, render, character_ids, "<eos>", 9, 40)
    with pytest.raises(ValueError, match="unreadable pairs: not_json"):
        score_file(parse_pairs(lines), *args)
    assert score_file(parse_pairs(lines), *args, on_bad="drop").count() == 1


def test_model_must_answer_every_sequence(spark):
    df = spark.createDataFrame([([1, 2], 1)], "input_ids array<int>, prompt_length int")
    with pytest.raises(Exception, match="one result per sequence"):
        pairs.score_sequences(df, lambda batch: []).collect()


def test_candidate_maps_leave_batch_by_batch(spark):
    """A batch is bounded by sequences and tokens, and one longer sequence goes alone; a task holds one batch at a time."""
    sizes = [3, 3, 3, 20, 1, 1, 1, 1, 1]
    rows = [(list(range(n)), k) for k, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "input_ids array<int>, k int").coalesce(1)

    def answer(batch):
        whole = ",".join(str(len(b)) for b in batch)
        return [[{t: float(len(whole.split(",")))} for t in b] for b in batch]

    got = pairs.score_sequences(df, answer, batch_size=4, batch_tokens=7)
    seen = {r.k: r.prompt_logprobs for r in got.collect()}
    assert [len(seen[k]) for k in range(len(sizes))] == sizes
    assert [int(seen[k][0][0]) for k in range(len(sizes))] == [2, 2, 1, 1, 4, 4, 4, 4, 1]
    with pytest.raises(ValueError):
        pairs.score_sequences(df, answer, batch_tokens=0)


@pytest.mark.parametrize("limit", ["10MB", "-1"])
def test_token_scoring_by_both_joins(spark, limit):
    """Broadcast and salted joins give the brute-force smoothed totals."""
    import math

    texts = spark.createDataFrame([("a b a", "m"), ("b c", "n")], "text string, lang string")
    rows = [(1, "A a d", "c"), (2, "b", "a.b,a")]
    found = spark.createDataFrame(rows, "id int, chosen string, rejected string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    try:
        tokens = pairs.token_table(texts, "text", "lang", ["m", "n"])
        assert fits_broadcast(tokens, 3) == (limit != "-1")
        got = pairs.score_pairs(found, tokens, ["base", "m", "n"], ["id"], salts=4).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    counts = {"base": {"a": 2, "b": 2, "c": 1}, "m": {"a": 2, "b": 1}, "n": {"b": 1, "c": 1}}
    words = {(1, "chosen"): "aad", (1, "rejected"): "c", (2, "chosen"): "b", (2, "rejected"): "aba"}
    assert len(got) == 12
    for r in got:
        n = counts[r.model]
        size = sum(n.values()) + len(n) + 1
        want = sum(math.log((n.get(w, 0) + 1) / size) for w in words[r.id, r.side])
        assert r.tokens == len(words[r.id, r.side])
        assert r.logprob == pytest.approx(want)


def test_text_functions(spark):
    texts = ["", "a", "a\n", "a\n\nb", "a\r\nb\rc", "x y\x0bz\x85", "\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.lines for r in df.select("i", split_lines(F.col("t")).alias("lines")).collect()}
    assert got == {i: t.splitlines() for i, t in enumerate(texts)}
    empty = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    assert df.where("i = 0").select(text_hash(F.col("t"))).first()[0] == empty
    values = [0.1, 100.0, 1e-5, 123456789012345.0, -2.5, 1 / 3, 0.0]
    numbers = spark.createDataFrame([(v,) for v in values], "v double")
    shown = numbers.select("v", general_format(F.col("v")).alias("s")).collect()
    assert all(r.s == f"{r.v:.12g}" for r in shown)
    emoji = spark.createDataFrame([("a\U0001f600b",)], "t string")
    assert emoji.select(character_ids(F.col("t"))).first()[0] == [97, 0x1F600, 98]
