"""Chains of steps as column pipelines.

A step is a function from DataFrame to DataFrame; a sequence is their composition, a mapping is a struct
column, a branch is a conditional. Prompts, parsers and memory are columns, and a model's answer is the
column that an adapter of ``lodestone.models`` makes from a prompt.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import formatted, trimmed
from lodestone.operators.aggregates import ordered
from lodestone.plans.lineage import cut_lineage, discard, running

Step = Callable[[DataFrame], DataFrame]
Answer = Callable[[Column], Column]


def sequence(*steps: Step | None) -> Step:
    """Steps one after the other; missing ones are passed over, none at all is an error."""
    real = [s for s in steps if s is not None]
    if not real:
        raise ValueError("a sequence needs a step")
    return lambda df: reduce(lambda d, s: d.transform(s), real, df)


def mapping(name: str, **branches: Column) -> Step:
    """Adds a struct of independent branches over the same row."""
    return lambda df: df.withColumn(name, F.struct(*(c.alias(k) for k, c in branches.items())))


def branch(name: str, cases: Sequence[tuple[Column, Column]], otherwise: Column | None = None) -> Step:
    """Adds the value of the first case whose condition holds."""
    value = F.when(*cases[0])
    for condition, then in cases[1:]:
        value = value.when(condition, then)
    return lambda df: df.withColumn(name, value.otherwise(otherwise) if otherwise is not None else value)


def split_branch(condition: Column, then: Step, otherwise: Step) -> Step:
    """For costly arms: each runs only on its own rows; a null condition goes to ``otherwise``."""
    sure = F.coalesce(condition, F.lit(False))
    return lambda df: df.where(sure).transform(then).unionByName(df.where(~sure).transform(otherwise), allowMissingColumns=True)


def typed_chain(read: Callable[[DataFrame], dict[str, Column]], template: str, answer: Answer, write: Callable[[Column], Column], *, name: str = "output") -> Step:
    """Adds an answer: ``read`` gives the prompt's values from a row's columns, ``write`` makes a typed value of the model's text."""
    return lambda df: df.withColumn(name, write(answer(prompt(template, **read(df)))))


def prompt(template: str, **values: Column) -> Column:
    return formatted(template, **values)


def few_shot(prefix: str, example: str, examples: Sequence[dict[str, str]], suffix: str, *, most_chars: int | None = None, **values: Column) -> Column:
    """A prompt of a prefix, examples each by the ``example`` template, as many as ``most_chars`` allows, and a suffix."""
    shown, left = [], most_chars
    for e in examples:
        text = example.format(**e)
        if left is not None:
            if len(text) > left:
                break
            left -= len(text)
        shown.append(text.replace("{", "{{").replace("}", "}}"))
    head = "\n".join([prefix, *shown]).replace("{{", "{").replace("}}", "}")
    return F.concat(F.lit(head + "\n"), formatted(suffix, **values))


def lines_of(text: Column) -> Column:
    """A model's answer as trimmed lines, blank ones dropped."""
    return F.filter(F.transform(F.split(text, "\n"), trimmed), lambda x: x != "")


def parsed(text: Column, schema: str) -> Column:
    """An answer in JSON as a struct; null where it isn't of that form."""
    return F.from_json(F.regexp_extract(text, r"(?s)\{.*\}", 0), schema)


def chat_memory(messages: DataFrame, last: int, *, by: str = "conv_id", order: str = "turn", role: str = "role", content: str = "text") -> DataFrame:
    """Each message with ``history``: ``role: text`` lines of up to ``last`` messages before it."""
    window = Window.partitionBy(by).orderBy(order).rowsBetween(-last, -1)
    line = F.concat(F.col(role), F.lit(": "), F.col(content))
    return messages.withColumn("history", F.array_join(F.collect_list(line).over(window), "\n"))


def citations(answer: Column, sources: Column) -> Column:
    """The sources that an answer cites as ``(source.n)``, n from 1, each once; numbers out of range are dropped."""
    numbers = F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\(source\.(\d{1,6})\)"), F.lit(1)), lambda n: n.cast("int")))
    return F.transform(F.filter(numbers, lambda n: (n >= 1) & (n <= F.size(sources))), lambda n: F.element_at(sources, n))


def numbered_sources(texts: Column) -> Column:
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("(source."), (i + 1).cast("string"), F.lit(") "), t)), "\n")


def rag(questions: DataFrame, retrieve: Step, answer: Answer, rephrase: Answer | None = None, *, question: str = "question", history: str | None = None) -> DataFrame:
    """``retrieve`` adds ``context`` for the original question; the answer is to the rephrased one.

    Adds ``asked`` and ``answer``.
    """
    asked = F.col(question)
    if rephrase is not None and history is not None:
        with_history = prompt("Chat history:\n{h}\nFollow-up question: {q}\nStandalone question:", h=F.col(history), q=F.col(question))
        asked = F.when(F.coalesce(F.col(history), F.lit("")) == "", F.col(question)).otherwise(rephrase(with_history))
    found = questions.transform(retrieve).withColumn("asked", asked)
    return found.withColumn("answer", answer(prompt("Context:\n{c}\nQuestion: {q}\nAnswer:", c=F.col("context"), q=F.col("asked"))))


def packs(texts: DataFrame, limit: int, *, by: str = "file_source", order: str = "page_no", size: Column | None = None, text: str = "text") -> DataFrame:
    """``texts`` with ``pack``, from 1 in each group: a pack ends before the text that makes it ``limit`` bytes or more.

    A text at least is in a pack. Where a pack begins tells where the next one does, so every text points to the first of the next pack
    as if it began one, and the pointers are doubled in each round: after n rounds the first 2 ** n packs of all groups are known. Sums run
    over ranges of rows and pointers are found in stretches of 64 limits, so a group of any size is many tasks' work. ``size`` is a whole
    number, 0 or more, by default the bytes of ``text``; null counts as 0.
    """
    if limit < 1:
        raise ValueError("a limit is 1 at least")
    length = F.coalesce(F.octet_length(text) if size is None else size, F.lit(0)).cast("bigint")
    rows = texts.select(F.struct(*(F.col(f"`{c}`") for c in texts.columns)).alias("row"), F.col(by).alias("g"), F.col(order).alias("o"), length.alias("s"))
    rows = cut_lineage(running(rows, ["g", "o"], F.col("s"), number="k", total="c"), "packs")
    ends = cut_lineage(rows.groupBy("g").agg(F.min("k").alias("first"), F.max("k").alias("last"), F.max("c").alias("all")), "packs-groups")
    wide = F.lit(64 * limit)
    at = rows.select("g", "k", (F.col("c") - F.col("s")).alias("before"))
    at = at.withColumn("own", F.floor(F.col("before") / wide))
    # The first texts of a stretch are also seen from the one before it.
    seen = F.when(F.col("before") % wide < limit, F.array(F.col("own"), F.col("own") - 1)).otherwise(F.array("own"))
    near = Window.partitionBy("g", "stretch").orderBy("before").rangeBetween(0, limit - 1)
    at = at.withColumn("stretch", F.explode(seen)).withColumn("far", F.max("k").over(near)).where(F.col("stretch") == F.col("own"))
    at = at.join(ends.withColumnRenamed("g", "eg"), F.col("g").eqNullSafe(F.col("eg"))).select("k", "far", "before", "last", "all")
    over = (F.col("far") < F.col("last")) | (F.col("all") >= F.col("before") + limit)
    jump = at.select("k", F.greatest(F.col("k") + 1, F.when(over, F.col("far")).otherwise(F.col("last") + 1)).alias("to"), "last").where(F.col("to") <= F.col("last"))
    jump = cut_lineage(jump.select("k", "to"), "packs-jump")
    written = [cut_lineage(ends.select(F.col("first").alias("k")), "packs-starts")]
    starts = written[0]
    while True:
        more = cut_lineage(starts.join(jump, "k").select(F.col("to").alias("k")), "packs-starts")
        written.append(more)
        if more.isEmpty():
            break
        starts = starts.union(more)
        after = cut_lineage(jump.join(jump.select(F.col("k").alias("to"), F.col("to").alias("then")), "to").select("k", F.col("then").alias("to")), "packs-jump")
        discard(jump)
        jump = after
    begins = cut_lineage(rows.select("k").join(starts.withColumn("b", F.lit(1)), "k", "left"), "packs-begins")
    counted = running(begins, ["k"], F.coalesce("b", F.lit(0)), number="_k", total="p").select("k", "p")
    base = counted.join(ends.select(F.col("first").alias("k"), F.col("g").alias("bg")), "k").select("bg", F.col("p").alias("base"))
    out = rows.join(counted, "k").join(base, F.col("g").eqNullSafe(F.col("bg")))
    out = cut_lineage(out.select("row", (F.col("p") - F.col("base") + 1).alias("pack")), "packed")
    discard(rows, ends, jump, begins, *written)
    return out.select(*(F.col("row")[c].alias(c) for c in texts.columns if c.lower() != "pack"), "pack")


def summaries(texts: DataFrame, summarise: Answer, limit: int, *, by: str = "file_source", text: str = "text", order: str = "page_no") -> DataFrame:
    """``by, summary``: a tree of summaries for each group.

    Each level summarises every text, joins neighbours into ``packs`` of less than ``limit`` bytes of summaries, and summarises each pack,
    until a group is one text. A level is a pass over all groups that aren't, written before the next. Where
    summaries are so long that no pack of a group holds two, the level joins them in pairs, so every level gets shorter.
    """
    here, done = cut_lineage(texts.select(F.col(by).alias("g"), F.col(order).cast("bigint").alias("o"), F.col(text).alias("t"))), None
    while True:
        each = packs(here.select("g", "o", summarise(F.col("t")).alias("t")), limit, by="g", order="o", text="t")
        sizes = each.groupBy("g").agg(F.count("*").alias("n"), F.max("pack").alias("most")).withColumnRenamed("g", "sg")
        alone = (F.col("n") > 1) & (F.col("n") == F.col("most"))
        each = each.join(sizes, F.col("g").eqNullSafe(F.col("sg"))).select("g", "o", "t", F.when(alone, F.floor((F.col("pack") + 1) / 2)).otherwise(F.col("pack")).alias("p"))
        joined = each.groupBy("g", "p").agg(F.array_join(ordered(F.col("t"), F.col("o")), "\n").alias("t"))
        after = cut_lineage(joined.select("g", F.col("p").alias("o"), summarise(F.col("t")).alias("t")))
        left = after.groupBy("g").agg(F.count("*").alias("n")).withColumnRenamed("g", "sg")
        after = cut_lineage(after.join(left, F.col("g").eqNullSafe(F.col("sg"))).select("g", "o", "t", "n"))
        ended = after.where("n = 1").select(F.col("g").alias(by), F.col("t").alias("summary"))
        done = ended if done is None else done.union(ended)
        discard(here)
        here = cut_lineage(after.where("n > 1").drop("n"))
        if here.isEmpty():
            return done


def ready_tasks(tasks: DataFrame, *, key: str = "index", needs: str = "dependencies", done: str = "done") -> DataFrame:
    """Unfinished tasks of a graph all of whose dependencies are finished."""
    open_ = tasks.where(~F.col(done))
    edges = open_.select(F.col(key).alias("_t"), F.explode(needs).alias("_d"))
    finished = tasks.where(F.col(done)).select(F.col(key).alias("_d"))
    waiting = edges.join(finished, "_d", "left_anti").select(F.col("_t").alias(key)).distinct()
    return open_.join(waiting, key, "left_anti")


def with_results(arguments: Column, results: Column) -> Column:
    """``$n`` and ``${n}`` replaced by results from a map of number to text."""
    return F.aggregate(F.map_entries(results), arguments, lambda a, e: F.regexp_replace(a, F.concat(F.lit(r"\$\{?"), e["key"].cast("string"), F.lit(r"(?!\d)\}?")), e["value"]))


def planned(text: Column) -> Column:
    """Lines ``n. name(arguments)`` of a plan as structs of index, name and arguments."""
    line = r"^\s*(\d+)\.\s*(\w+)\((.*)\)\s*(?:#.*)?$"
    rows = F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(line)))
    return F.transform(rows, lambda x: F.struct(F.regexp_extract(x, line, 1).cast("int").alias("index"), F.regexp_extract(x, line, 2).alias("name"), F.regexp_extract(x, line, 3).alias("arguments")))


def react(text: Column) -> Column:
    """A ReAct answer as a struct: thought, action, action_input, final_answer; parts that are missing are empty."""
    part = lambda p: F.regexp_extract(text, p, 1)
    return F.struct(
        part(r"(?s)Thought:\s*(.*?)\s*(?:\nAction:|\nFinal Answer:|\z)").alias("thought"), part(r"\nAction:[ \t]*([^\n]*?)[ \t]*(?:\n|\z)").alias("action"),
        part(r"(?s)\nAction Input:\s*(.*?)\s*(?:\nObservation:|\z)").alias("action_input"), part(r"(?s)Final Answer:\s*(.*?)\s*\z").alias("final_answer"),
    )


def unanswered(calls: DataFrame, answers: DataFrame, *, key: str = "tool_call_id") -> DataFrame:
    """Required tool calls without a submitted answer."""
    return calls.join(answers.select(key).distinct(), key, "left_anti")
