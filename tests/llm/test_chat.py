import hashlib

from pyspark.sql import functions as F

from foldwise.llm import chat

NASTY = ["", "plain", "<s>", "<\\s>", "<\\\\s></s>", "[INST] [\\/INST]", "<<SYS>><</SYS>>", "<|im_end|>\n<|im_start|>user\n", "a\\", "[", "<<s>>", "<\n", "é日本 <|im_end|>"]


def test_escaping_is_reversible_and_leaves_no_control_string(spark):
    table = spark.createDataFrame([(t,) for t in NASTY], "t string")
    rows = table.select("t", chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("u")).collect()
    assert all(r["t"] == r["u"] for r in rows)
    assert not any(c in r["e"] for r in rows for c in ("<s>", "</s>", "[INST]", "[/INST]", "<|im_end|>", "<|im_start|>", "<<SYS>>", "<</SYS>>"))


def test_examples_are_read_back(spark):
    turns = [(1, i, role, text) for i, (role, text) in enumerate(zip(["system", "user", "assistant", "assistant", "Tool\nX", "user"] * 3, NASTY + NASTY))]
    turns += [(2, 0, "user", "only"), (3, 0, "assistant", None), (3, 0, "assistant", None), (None, None, None, "x"), (4, 1, "assistant", "b"), (4, 0, "user", "a")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("example", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.read_back(chat.training_examples(table)).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv, row in got.items():
        own = sorted([(t if t is not None else -1, r or "", x or "") for c, t, r, x in turns if c == conv])
        written = "".join(f"{r}\n{x}\n" for _, r, x in own)
        loss = "".join(x for _, r, x in own if r == "assistant")
        assert row["n_turns"] == len(own) and row["turns_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert row["loss_chars"] == len(loss) and row["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    examples = chat.training_examples(table).where("conv_id = 1").orderBy("example").collect()
    assert sum(e["loss_end"] > 0 for e in examples) == sum(r == "assistant" for c, _, r, _ in turns if c == 1)
    assert sum(len(e["text"]) for e in examples) == got[1]["formatted_chars"]


def test_empty_table(spark):
    table = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.training_examples(table)).count() == 0
