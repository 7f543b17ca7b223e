"""Quality rules: statistics of whole texts, and decision lists learned from labels.

Everything on the main path is a Spark expression. The learner works on the
driver over the statistics of a bounded sample of labelled documents, and its
list of rules goes back into Spark as ordered conditional expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The contract's symbols, word gaps and limits.
SYMBOLS = "#*$%&|<>"
GAPS = " \t\n\x0b\f\r"
WINDOW = 8
#: What rules may test.
FEATURES = ("mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "distinct_share", "n_words")


def _bind(value: str, name: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _repeats(words: str) -> str:
    """SQL for the words in 8-word windows found twice or more. Windows compare by 64-bit hashes within one text."""
    spread = (
        f"aggregate(transform(at, (p, k) -> least({WINDOW}, coalesce(get(at, k + 1), p + {WINDOW}) - p)), 0L, (s, x) -> s + x)"
    )
    starts = "sort_array(filter(transform(hs, (e, k) -> if(e.h = get(hs, k - 1).h or e.h = get(hs, k + 1).h, e.i, null)), p -> p is not null))"
    found = _bind("sort_array(transform(h, (x, i) -> named_struct('h', x, 'i', i)))", "hs", _bind(starts, "at", spread))
    some = f"if(size(array_distinct(h)) = size(h), 0L, {found})"
    hashes = f"transform(sequence(1, size({words}) - {WINDOW - 1}), i -> xxhash64(slice({words}, i, {WINDOW})))"
    return f"if(size({words}) <= {WINDOW}, 0L, {_bind(hashes, 'h', some)})"


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the contract's counts to ``docs``, and the shares that rules test (in the struct ``_f``).

    Null and empty texts have no words and every statistic 0. No column of
    ``docs`` but ``text`` is read.
    """
    words = "filter(split(coalesce(_t, ''), '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w != '')"
    lines = "filter(split(coalesce(_t, ''), '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"
    t = F.coalesce(F.col("_t"), F.lit(""))
    df = docs.withColumn("_t", F.col(text))
    body = f"named_struct('n', cast(size(ws) as long), 'd', cast(size(array_distinct(ws)) as long), 'r', {_repeats('ws')})"
    df = df.withColumn("_w", F.expr(_bind(words, "ws", body)))
    df = df.withColumn("_l", F.expr(_bind(lines, "ls", "named_struct('n', cast(size(ls) as long), 'd', cast(size(ls) - size(array_distinct(ls)) as long))")))
    df = df.withColumns({
        "n_words": F.col("_w.n"),
        "word_chars": F.char_length(F.translate(t, GAPS, "")).cast("long"),
        "n_symbols": (F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": F.col("_l.d"),
        "n_repeat_words": F.col("_w.r"),
        "_upper": F.char_length(t) - F.char_length(F.regexp_replace(t, r"\p{Lu}", "")),
    })
    share = lambda a, b: F.coalesce(F.col(a) / F.when(F.col(b) > 0, F.col(b)), F.lit(0.0)).cast("double")
    features = F.struct(
        share("word_chars", "n_words").alias("mean_word"),
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_dup_lines", "_l.n").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
        share("_upper", "word_chars").alias("upper_share"),
        share("_w.d", "n_words").alias("distinct_share"),
        F.col("n_words").cast("double").alias("n_words"),
    )
    return df.withColumn("_f", features).drop("_t", "_w", "_l", "_upper")


@dataclass(frozen=True)
class Rule:
    """Rejects what meets all of ``tests``: (feature, '>=' or '<', threshold)."""

    tests: tuple
    precision: float
    covered: int

    def column(self) -> Column:
        out = F.lit(True)
        for name, op, x in self.tests:
            out &= F.col(f"_f.{name}") >= F.lit(x) if op == ">=" else F.col(f"_f.{name}") < F.lit(x)
        return out


def _covers(tests, row) -> bool:
    return all(row[n] >= x if op == ">=" else row[n] < x for n, op, x in tests)


def learn(rows: list[tuple[dict, bool]], features: tuple = FEATURES, cuts: int = 24, longest: int = 3, most_rules: int = 8, precision: float = 0.97, support: int = 5) -> list[Rule]:
    """A decision list by sequential covering, from (statistics, is bad) pairs.

    Every third row prunes, the others grow. A rule grows by the test with the
    highest information gain until it is pure; on the pruning rows trailing
    tests go while that doesn't lower its worth; a rule under ``precision`` or
    ``support`` on either ends the list, so clean documents are left alone.
    What a rule covers is taken out before the next one grows.
    """
    import math

    grow = [r for i, r in enumerate(rows) if i % 3]
    prune = [r for i, r in enumerate(rows) if not i % 3]
    tests = []
    for name in features:
        values = sorted({r[name] for r, _ in grow})
        steps = sorted({values[min(len(values) - 1, i * len(values) // cuts)] for i in range(1, cuts + 1)}) if values else []
        tests += [(name, op, x) for x in steps for op in (">=", "<")]
    rules: list[Rule] = []
    while len(rules) < most_rules and any(bad for _, bad in grow):
        mine: tuple = ()
        here = grow
        while len(mine) < longest and any(not bad for _, bad in here):
            p0 = sum(bad for _, bad in here)
            was = math.log2(p0 / len(here))
            best = (0.0, None, None)
            for t in tests:
                inside = [r for r in here if _covers((t,), r[0])]
                p = sum(bad for _, bad in inside)
                if p and (gain := p * (math.log2(p / len(inside)) - was)) > best[0]:
                    best = (gain, t, inside)
            if best[1] is None:
                break
            mine, here = (*mine, best[1]), best[2]

        def worth(ts):
            inside = [bad for r, bad in prune if _covers(ts, r)]
            return (2 * sum(inside) - len(inside)) / len(inside) if inside else -1.0

        while len(mine) > 1 and worth(mine[:-1]) >= worth(mine):
            mine = mine[:-1]
        judged = [[bad for r, bad in part if _covers(mine, r)] for part in (grow, prune)]
        if not mine or any(len(j) < support or sum(j) < precision * len(j) for j in judged):
            break
        both = judged[0] + judged[1]
        rules.append(Rule(mine, sum(both) / len(both), len(both)))
        grow = [r for r in grow if not _covers(mine, r[0])]
        prune = [r for r in prune if not _covers(mine, r[0])]
    return rules


def fit(docs: DataFrame, labels: DataFrame, most_rows: int = 8_000, id_col: str = "doc_id", text: str = "text") -> list[Rule]:
    """Rules from the labelled documents with the smallest hashed ids, ``most_rows`` of them at most.

    That bound is all that is sampled, and it bounds what reaches the driver.
    An id labelled twice is bad if any label says so; null labels are left out;
    without labels there are no rules.
    """
    ids = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("_q"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows).withColumnRenamed("doc_id", "_id")
    some = docs.join(F.broadcast(ids), F.col(id_col) == F.col("_id")).select(id_col, text, "_q")
    got = statistics(some, text).select(id_col, "_f", "_q", _base_failed().alias("_failed"))
    # A repeated document counts once; those the base test rejects teach nothing. They are left out here, as Spark would test for it before the join.
    got = got.groupBy(id_col).agg(F.min(F.struct("_f", "_q", "_failed")).alias("r")).orderBy(F.xxhash64(id_col), id_col)
    return learn([(r.r._f.asDict(), r.r._q == 0) for r in got.collect() if not r.r._failed])


def _base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def verdict(rules: list[Rule]) -> Column:
    """The rule that rejects a document, by its place in the list; -1 if none does."""
    out = F.when(F.lit(False), F.lit(-1))
    for k, rule in enumerate(rules):
        out = out.when(rule.column(), F.lit(k))
    return out.otherwise(F.lit(-1))


def quality_rules(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """``docs`` with the counts, ``base_failed``, ``rule`` (-1: none) and ``kept``; columns of ``docs`` of these names are replaced.

    Null and empty texts fail the base test. Repeated rows are judged alike.
    """
    df = statistics(docs, text).withColumn("base_failed", _base_failed())
    df = df.withColumn("rule", verdict(rules)).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == -1))
    return df.drop("_f")
