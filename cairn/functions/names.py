"""What a heritage name asserts, and how alike two names are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import bigram_dice, bigram_set, is_subset, let, tokenise

#: Phrases that place the subject relative to something else, richer forms first.
RELATIONS = (
    r"\b(?:approximately|approx|about|circa)?\s*\d+(?:\.\d+)?\s*(?:m|metres?|meters?|yards?|yds?|ft|feet)\b[\s\S]*?\bof\b",
    r"\b(?:to\s+(?:the\s+)?)?(?:north|south|east|west)(?:[\s-]?(?:east|west))?\s+of\b",
    r"\b(?:n|s|e|w|ne|nw|se|sw)\s+of\b",
    r"\battached\s+to\b",
    r"\badjoining\b",
    r"\badjacent\s+to\b",
    r"\bin\s+front\s+of\b",
    r"\bin\s+the\s+(?:garden|grounds|churchyard|precinct|forecourt)s?\s+of\b",
    r"\bforecourt\s+of\b",
    r"\bassociated\s+with\b",
    r"\boutside\b",
    r"\bwithin\b",
    r"\bat\b",
    r"\bto\b",
)
RELATION = "(?i)(?:" + "|".join(RELATIONS) + ")"
STREET = r"(?i)^\s*(\d+[a-z]?(?:\s*(?:-|–|and|&)\s*\d+[a-z]?)*)\b"
#: Tokens that so many names have that a name made of them alone identifies nothing.
GENERIC = tuple(
    """church chapel churchyard cross monument memorial milestone bridge barn house farm farmhouse cottage cottages hall mill windmill station castle abbey priory
    grange lodge gate gates wall walls stocks well tower school inn village green manor court park garden gardens site remains ruins former building buildings
    works yard boundary marker lock aqueduct canal railway signal box pillbox shelter barrow cairn earthwork enclosure settlement
    st saint saints all holy trinity mary virgin john peter paul james andrew michael george nicholas margaret helen lawrence laurence martin giles oswald cuthbert
    bartholomew gregory matthew hilda edmund leonard chad magdalene baptist evangelist stephen thomas anne ann
    north south east west northern southern eastern western great little upper lower old new high low middle number no approximately metres metre yards yard""".split()
)


def _cut(x: Column) -> dict[str, Column]:
    """The parts of a name, cut at its first relational phrase: head, relation, placed (the relation's tokens), objects and numbers of the street."""
    at = F.regexp_instr(x, F.lit(RELATION))
    phrase = F.regexp_extract(x, RELATION, 0)
    has = at > 1
    relation = F.when(has, F.trim(F.substr(x, at)))
    head = F.when(has, F.trim(F.substr(x, F.lit(1), at - 1))).otherwise(F.trim(x))
    street = F.nullif(F.regexp_extract(x, STREET, 1), F.lit(""))
    none = F.array().cast("array<string>")
    numbers = F.coalesce(F.transform(F.split(street, r"(?i)\s*(?:-|–|and|&)\s*"), lambda n: F.lower(F.trim(n))), none)
    placed = F.when(has, tokenise(relation)).otherwise(none)
    objects = F.when(has, tokenise(F.substr(relation, F.length(phrase) + 1))).otherwise(none)
    return {"head": head, "relation": relation, "placed": placed, "objects": objects, "numbers": numbers}


def analyse(name: Column) -> Column:
    """Struct (head, head_tokens, relation, relation_tokens, object_tokens, street_numbers, chars, bigrams, n_tokens, head_sorted, relation_sorted).

    The part after ; or : is dropped, then the name is cut at its first relational phrase, unless it starts with one.
    All that a comparison needs is made here, once a record: chars are the joined head tokens, n_tokens how many of them
    differ, and tokens that are sorted and joined tell equal lists, as no token has a space.
    """

    def parts(x: Column) -> Column:
        cut = _cut(x)
        ordered = lambda tokens: F.array_join(F.array_sort(tokens), " ")
        return let(tokenise(cut["head"]), lambda tokens: let(F.array_join(tokens, " "), lambda chars: F.struct(
            cut["head"].alias("head"),
            tokens.alias("head_tokens"),
            cut["relation"].alias("relation"),
            cut["placed"].alias("relation_tokens"),
            cut["objects"].alias("object_tokens"),
            cut["numbers"].alias("street_numbers"),
            chars.alias("chars"),
            bigram_set(chars).alias("bigrams"),
            F.size(F.array_distinct(tokens)).alias("n_tokens"),
            ordered(tokens).alias("head_sorted"),
            ordered(cut["placed"]).alias("relation_sorted"),
        )))

    return let(F.split(name, "[;:]")[0], parts)


def packed(name: Column) -> Column:
    """What analyse() says of a name as one short text: head tokens, r if it has a relation, the relation's tokens, objects and street numbers, by |; tokens have neither | nor spaces."""

    def parts(x: Column) -> Column:
        cut = _cut(x)
        joined = lambda tokens: F.array_join(tokens, " ")
        related = F.when(cut["relation"].isNotNull(), "r").otherwise("")
        return F.concat_ws("|", joined(tokenise(cut["head"])), related, joined(cut["placed"]), joined(cut["objects"]), joined(cut["numbers"]))

    return let(F.split(name, "[;:]")[0], parts)


def is_generic(name: Column) -> Column:
    """All tokens are generic words or figures, or there are none."""
    return F.forall(tokenise(name), lambda t: t.isin(*GENERIC) | t.rlike(r"^\d+$"))


def _against(a: Column, b: Column) -> Column:
    """a is placed relative to b."""
    return (
        a["relation"].isNotNull() & (F.size(a["object_tokens"]) > 0) & b["relation"].isNull()
        & is_subset(b["head_tokens"], a["object_tokens"]) & ~is_subset(a["head_tokens"], b["head_tokens"]) & (F.size(a["head_tokens"]) > 0)
    )


def distinct_things(a: Column, b: Column) -> Column:
    """Two analysed names denote different things: other street numbers, another position, or one beside the other."""
    streets = (F.size(a["street_numbers"]) > 0) & (F.size(b["street_numbers"]) > 0) & ~F.arrays_overlap(a["street_numbers"], b["street_numbers"])
    moved = a["relation"].isNotNull() & b["relation"].isNotNull() & (a["head_sorted"] == b["head_sorted"]) & (a["relation_sorted"] != b["relation_sorted"])
    return streets | moved | _against(a, b) | _against(b, a)


def _one_each(a: Column, b: Column) -> Column:
    return (F.size(a) == 1) & (F.size(b) == 1)


def all_pairs_distinct(a: Column, b: Column) -> Column:
    """Every pair from two arrays of analysed names is distinct; false if either is empty."""
    every = (F.size(a) > 0) & (F.size(b) > 0) & F.forall(a, lambda x: F.forall(b, lambda y: distinct_things(x, y)))
    return F.when(_one_each(a, b), distinct_things(F.get(a, F.lit(0)), F.get(b, F.lit(0)))).otherwise(every)


def _measured(a: Column, b: Column) -> Column:
    """Struct (dice, containment, weight) of two analysed names, each measure made once; both are 0 if either has no tokens."""
    some = (a["n_tokens"] > 0) & (b["n_tokens"] > 0)
    inside = F.size(F.array_intersect(a["head_tokens"], b["head_tokens"])) / F.least(a["n_tokens"], b["n_tokens"])
    weight = F.when(a["relation"].isNotNull() | b["relation"].isNotNull(), 0.7).otherwise(0.95)
    chars = bigram_dice(a["chars"], a["bigrams"], b["chars"], b["bigrams"])
    return F.struct(F.when(some, chars).otherwise(0.0).alias("dice"), F.when(some, inside).otherwise(0.0).alias("containment"), weight.alias("weight"))


def _scored(m: Column) -> Column:
    weighted = m["containment"] * m["weight"]
    return F.struct(F.greatest(m["dice"], weighted).alias("score"), m["dice"].alias("dice"), m["containment"].alias("containment"), (weighted > m["dice"]).alias("carried"))


def similarity(a: Column, b: Column) -> Column:
    """Struct (score, dice, containment, carried): the greater of dice and weighted containment of two analysed names."""
    return let(_measured(a, b), _scored)


def _best(a: Column, b: Column) -> Column:
    pairs = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: similarity(x, y))))
    none = F.struct(F.lit(0.0).alias("score"), F.lit(0.0).alias("dice"), F.lit(0.0).alias("containment"), F.lit(False).alias("carried"))
    return F.aggregate(pairs, none, lambda best, s: F.when(s["score"] > best["score"], s).otherwise(best))


def best_similarity(a: Column, b: Column) -> Column:
    """The best similarity over two arrays of analysed names; the first of equals."""
    return F.when(_one_each(a, b), similarity(F.get(a, F.lit(0)), F.get(b, F.lit(0)))).otherwise(_best(a, b))


def with_best_similarity(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with sim, the best similarity over two columns of analysed names.

    Two single names, which most pairs have, are measured in a projection of their own, as compiled code: inside a
    function of arrays all would be interpreted.
    """
    x, y = F.col(a), F.col(b)
    single = pairs.withColumn("measured", F.when(_one_each(x, y), _measured(F.get(x, F.lit(0)), F.get(y, F.lit(0)))))
    m = F.col("measured")
    return single.withColumn("sim", F.when(m.isNotNull(), _scored(m)).otherwise(_best(x, y))).drop("measured")
