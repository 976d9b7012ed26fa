from lodestone.llm import quotations as Q

SCHEMA = "conv_id long, turn long, role string, text string, position string, depth string"


def order(spark, rows):
    df = spark.createDataFrame([(*r, "p", "d") for r in rows], SCHEMA)
    return sorted(Q.reply_order(df).collect(), key=lambda r: (r.conv_id, r.position))


def test_quotes_link_to_their_messages_and_go(spark):
    rows = [
        (1, 0, "a", "First idea, with words.\nSecond line."),
        (1, 1, "b", "> First idea -- with WORDS\nI agree."),
        (1, 2, "c", "> Second line.\nWhat about this?"),
        (1, 3, "d", ">> First idea, with words.\n> I agree.\n\nSo do I.\n"),
        (1, 4, "e", "> something nobody wrote\nHm."),
    ]
    got = order(spark, rows)
    assert [(r.turn, r.parent_turn, r.depth) for r in got] == [(0, None, 0), (1, 0, 1), (3, 1, 2), (4, 3, 3), (2, 0, 1)]
    assert {r.turn: r.text for r in got} == {0: "First idea, with words.\nSecond line.", 1: "I agree.", 2: "What about this?", 3: "So do I.", 4: "Hm."}
    assert {r.turn: (r.quoted_lines, r.linked_lines) for r in got} == {0: (0, 0), 1: (1, 1), 2: (1, 1), 3: (2, 2), 4: (1, 0)}


def test_edges(spark):
    rows = [(None, 0, "a", "x"), (2, None, "a", "late"), (2, 0, None, None), (2, 0, "b", "y " * 20_000), (2, 0, "b", "y " * 20_000), (2, 1, "c", ""), (3, 5, "a", "> > ")]
    got = order(spark, rows)
    assert [(r.conv_id, r.turn, r.text is None) for r in got] == [(2, 0, True), (2, 0, False), (2, 0, False), (2, 1, False), (2, None, False), (3, 5, False)]
    assert order(spark, []) == []


def test_whole_table_in_turn_order_without_quotes(spark, sf):
    talk = spark.read.parquet(f"{sf}/conversations.parquet")
    got = Q.reply_order(talk).toPandas().sort_values(["conv_id", "position"])
    want = talk.toPandas().sort_values(["conv_id", "turn"])
    assert got["turn"].tolist() == want["turn"].tolist() and got["text"].tolist() == want["text"].str.strip().tolist()
