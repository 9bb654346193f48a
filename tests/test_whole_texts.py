"""Queries over texts read them to their ends."""

from tidemark.plans import relational, text
from tidemark.plans.base import events


def test_questions_hold_the_whole_text(spark, tmp_path):
    texts = {1: "a word " * 20 + "at 00:01:02 the Mesh was seen", 2: "short"}
    spark.createDataFrame([(i, 0, "user", t) for i, t in texts.items()], "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    prompts = {r.conv_id: r.prompt for r in text.txt_prompt_assembly(spark, str(tmp_path)).collect()}
    assert all(t in prompts[i] for i, t in texts.items())
    templates = [r.template for r in text.txt_template_fold(spark, str(tmp_path)).collect()]
    assert any("at <TS> the <FO> was seen" in t for t in templates)


def test_documents_are_read_to_their_ends(spark, tmp_path):
    parts = [a + b + c for a in "bcdfghjklm" for b in "aeiouwxyzq" for c in "npqrstvxzk"]
    doc = "First sentence. " + "x " * 150 + " ".join([*parts, *parts, "the", "erand"])
    spark.createDataFrame([(i, doc) for i in range(12)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = lambda f, c: {r.doc_id: r[c] for r in f(spark, str(tmp_path)).collect()}
    assert set(out(text.txt_entities_longest_first, "hits")[1].split(",")) >= {"erand", "the"}
    assert out(text.txt_word_replace, "v")[1] == doc.replace(" the ", " mesh ")
    assert out(text.txt_distinct_list, "v")[1] == ", ".join(["First", "sentence", "x", *parts, "the", "erand"])
    assert all(p in out(text.txt_canonical_list, "v")[1] for p in ("the", "erand", parts[-1]))
    assert set(out(text.txt_sentence_dropout, "v").values()) <= {doc, doc.removeprefix("First sentence. ")}


def test_edit_score_of_whole_sequences(spark, sf):
    seqs = {}
    for r in events(spark, sf).orderBy("event_id").collect():
        own = seqs.setdefault(r.user_id, [])
        if not own or own[-1] != r.cls[0]:
            own.append(r.cls[0])
    assert max(map(len, seqs.values())) > 40
    got = {r.user_id: r.score for r in relational.sc_edit_score(spark, sf).collect()}
    assert got.keys() == seqs.keys()
    for user, s in seqs.items():
        row = list(range(len(s) + 1))
        for i, a in enumerate(s, 1):
            last, row = row, [i]
            for j, b in enumerate(reversed(s), 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (a != b)))
        assert abs(got[user] - 100 * (1 - row[-1] / len(s))) < 1e-6
