"""Frames and triples of parsed sentences, one row a sentence: nothing is shuffled before rows are aggregated.

A sentence's tokens are one array of structs in order, `i` their place from 0 (see
``providers.TOKENS``). Target terms, governing verbs, children, candidates and agents are
found inside the array. Ways up the tree are found for all tokens at once by doubling
pointers, so a sentence of n tokens takes n log n steps, and a candidate verb's children
one pass each.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.functions.text import let
from lexmill.operators.frames import agent_category, role_of


def pointers(tokens: Column, first: Callable[[Column], Column]) -> Column:
    """For each token where its way ends: first(token) is the next token's place, or a negative end."""
    steps = F.greatest(F.lit(1), F.ceil(F.log2(F.size(tokens) + 1)).cast("int"))
    double = lambda p, _: F.transform(p, lambda x: F.when(x >= 0, F.get(p, x)).otherwise(x))
    return F.aggregate(F.sequence(F.lit(1), steps), F.transform(tokens, first), double)


def found_at(p: Column, i: Column) -> Column:
    """The place that the way of token i ends at, null if it ends at the root (or in a circle)."""
    end = F.get(p, i)
    return F.when(end < -1, -2 - end)


def verb_pointers(tokens: Column) -> Column:
    """Ways to the nearest ancestor that is a verb."""
    head = lambda t: F.get(tokens, t["head_i"])
    return pointers(tokens, lambda t: F.when(t["head_i"] == t["i"], F.lit(-1)).when(head(t)["pos"] == "VERB", -2 - t["head_i"]).otherwise(t["head_i"]))


def noun_pointers(tokens: Column) -> Column:
    """Ways to the noun that the nearest relative clause around a token modifies."""
    top = lambda t: t["head_i"] == t["i"]
    return pointers(tokens, lambda t: F.when(top(t), F.lit(-1)).when(t["dep"] == "relcl", -2 - t["head_i"]).otherwise(t["head_i"]))


def spoken(tokens: Column) -> Column:
    return F.array_join(F.transform(tokens, lambda t: t["text"]), " ")


def part(tokens: Column, low: Column, high: Column) -> Column:
    return F.filter(tokens, lambda t: (t["i"] >= low) & (t["i"] <= high))


def frames(sentences: DataFrame, terms: tuple[str, ...], tokens: str = "tokens") -> DataFrame:
    """sentences' rows, one for each token whose text or lemma is a target term, with the columns of frames.parsed_frames()."""
    wanted = [t.lower() for t in terms]
    s = F.col(tokens)
    hits = F.filter(s, lambda t: F.lower(t["text"]).isin(*wanted) | F.lower(t["lemma"]).isin(*wanted))
    rows = sentences.withColumn("_hits", hits).where(F.size("_hits") > 0)
    rows = rows.withColumns({"_verbs": verb_pointers(s), "sentence": spoken(s)}).withColumn("_h", F.explode("_hits")).drop("_hits")
    h = F.col("_h")
    rows = rows.withColumns(
        {
            "_head": F.get(s, h["head_i"]),
            "verb_i": found_at(F.col("_verbs"), h["i"]),
            "_c": F.filter(s, lambda c: (c["head_i"] == h["i"]) & (c["i"] != c["head_i"])),
        }
    )
    verb = F.get(s, F.col("verb_i"))
    modifies = lambda c: c["pos"].isin("ADJ", "ADV") | c["dep"].isin("amod", "advmod", "compound")
    return rows.withColumns(
        {
            "token_idx": h["i"],
            "target_term": h["text"],
            "target_lemma": F.lower(h["lemma"]),
            "dep_head": F.col("_head.text"),
            "dep_head_lemma": F.col("_head.lemma"),
            "dep_head_pos": F.col("_head.pos"),
            "dep_relation": h["dep"],
            "dep_children": F.transform("_c", lambda c: F.struct(c["text"].alias("text"), c["dep"].alias("dep"), c["pos"].alias("pos"))),
            "syntactic_role": role_of(h["dep"], F.col("_head.voice")),
            "modifiers": F.transform(
                F.filter("_c", modifies), lambda c: F.struct(c["text"].alias("text"), c["lemma"].alias("lemma"), c["pos"].alias("pos"), c["dep"].alias("dep"))
            ),
            "governing_verb": verb["lemma"],
            "verb_text": verb["text"],
            "subtree_text": spoken(part(s, h["left"], h["right"])),
        }
    ).drop("_h", "_head", "_c", "_verbs")


def agent_of(s: Column, nouns: Column, v: Column) -> Column:
    """(tag, agent_text, agent_lemma, voice, by_phrase) of token v taken for a verb; voice null where it has neither agent nor passive."""

    def read(kids: Column) -> Column:
        be = F.exists(kids, lambda k: k["dep"].isin("auxpass", "aux") & (F.lower(k["lemma"]) == "be"))
        passive = F.exists(kids, lambda k: k["dep"] == "auxpass") | ((v["tag"] == "VBN") & be)
        by = F.get(F.filter(kids, lambda k: k["dep"] == "agent"), F.lit(0))
        subject = F.get(F.filter(kids, lambda k: k["dep"].isin("nsubj", "csubj")), F.lit(0))
        return F.struct(passive.alias("passive"), by.alias("by"), subject.alias("subject"))

    def place(a: Column) -> Column:
        pobj = F.get(F.filter(s, lambda k: (k["dep"] == "pobj") & (k["head_i"] == a["by"]["i"])), F.lit(0))
        pronoun = F.lower(a["subject"]["lemma"]).isin("which", "that", "who", "whom")
        noun = F.get(s, F.when(~a["passive"] & pronoun, found_at(nouns, v["i"])))
        # the span that names the agent
        who = F.when(a["passive"], F.coalesce(F.when(a["by"].isNotNull(), pobj), a["by"])).otherwise(F.coalesce(noun, a["subject"]))
        return F.struct(a.alias("a"), who.alias("who"), pobj["i"].isNull().alias("bare"), noun["i"].isNotNull().alias("relative"))

    def name(w: Column) -> Column:
        a, passive = w["a"], w["a"]["passive"]
        voice = F.when(passive, F.lit("passive")).when(a["subject"].isNotNull(), F.lit("active"))
        named = voice.isNotNull() & w["who"].isNotNull()

        def text(held: Column) -> Column:
            plain = F.array_join(F.transform(F.filter(held, lambda t: ~t["pos"].isin("DET", "PUNCT")), lambda t: t["lemma"]), " ")
            lemma = F.when(passive & w["bare"], F.lower(a["by"]["lemma"])).when(w["relative"], F.lower(spoken(held))).otherwise(plain)
            return F.struct(
                v["tag"].alias("tag"), F.when(named, spoken(held)).alias("agent_text"), F.when(named, lemma).alias("agent_lemma"),
                voice.alias("voice"), F.when(passive, a["by"].isNotNull()).alias("by_phrase"),
            )

        return let(part(s, w["who"]["left"], w["who"]["right"]), text)

    kids = F.filter(s, lambda k: (k["head_i"] == v["i"]) & (k["i"] != k["head_i"]))
    return let(let(let(kids, read), place), name)


def agent_of_wanted(s: Column, nouns: Column, lemma: Column, text: Column) -> Column:
    """The agent of a verb known by lemma and text: of the first candidate that has one or is passive, else of a participle; null if there is none.

    Candidates are the tokens of the first of three kinds that has any: verbs of that
    lemma, verbs of that text, any token of that lemma.
    """
    verbal = lambda t: t["pos"].isin("VERB", "AUX")
    same = lambda t: F.lower(t["lemma"]) == F.lower(lemma)
    some = lambda found, other: let(found, lambda c: F.when(F.size(c) > 0, c).otherwise(other))
    by_text = F.filter(s, lambda t: (F.lower(t["text"]) == F.lower(text)) & verbal(t))
    candidates = some(F.filter(s, lambda t: same(t) & verbal(t)), some(by_text, F.filter(s, same)))
    none = F.lit(None).cast("string")
    bare = lambda p: F.when(p.isNotNull(), F.struct(p["tag"].alias("tag"), none.alias("agent_text"), none.alias("agent_lemma"), F.lit("passive").alias("voice"), F.lit(False).alias("by_phrase")))  # noqa: E731, E501
    first = lambda each, held: F.get(F.filter(each, held), F.lit(0))
    pick = lambda each: F.coalesce(first(each, lambda a: a["voice"].isNotNull()), let(first(each, lambda a: a["tag"] == "VBN"), bare))
    return let(F.transform(candidates, lambda v: agent_of(s, nouns, v)), pick)


def triples(sentences: DataFrame, terms: tuple[str, ...], tokens: str = "tokens") -> DataFrame:
    """frames() of patients, with agent_text, agent_lemma, voice, by_phrase and agent_category of their verb, without the tokens."""
    s = F.col(tokens)
    rows = frames(sentences, terms, tokens).where("syntactic_role = 'patient'")
    rows = rows.withColumn("_nouns", F.when(F.col("governing_verb").isNotNull(), noun_pointers(s)))
    rows = rows.withColumn("_a", F.when(F.col("governing_verb").isNotNull(), agent_of_wanted(s, F.col("_nouns"), F.col("governing_verb"), F.col("verb_text"))))
    rows = rows.drop(tokens, "_nouns").select("*", "_a.agent_text", "_a.agent_lemma", F.col("_a.voice").alias("_voice"), "_a.by_phrase").drop("_a")
    category = (
        F.when(F.col("governing_verb").isNull(), "NO_VERB")
        .when(F.col("_voice").isNull(), "UNRESOLVED")
        .when(F.col("agent_text").isNull(), "AGENTLESS")
        .otherwise(agent_category(F.col("agent_text"), F.col("agent_lemma")))
    )
    return rows.withColumns({"agent_category": category, "voice": F.coalesce("_voice", F.lit("unknown"))}).drop("_voice")


def sentences_of(tokens: DataFrame, key: tuple[str, ...] = ("chunk_id", "sent_id")) -> DataFrame:
    """One row a sentence from a table of one row a token; tokens' `i` must count up from 0."""
    token = F.struct("i", "text", "lemma", "pos", "tag", "dep", "head_i", "left", "right", "voice")
    return tokens.groupBy(*key).agg(F.array_sort(F.collect_list(token)).alias("tokens"))
