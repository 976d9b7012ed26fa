"""Word lists that retrieval and extraction rely on."""

STOPWORDS = frozenset(
    """
    a i be he me we if of an in on do go no so to up or as is us at it by my had did and see she the one are use
    all him can who two her for our has was his its get not but out you new how now day say way any said good
    make take like time come some were have give with back look work well will them from than been then when even
    also into year over your this that what want most just know they only could would there these which think
    other after their first about people because
    """.split()
)
"""Left out of keyword statistics and of the keyword index."""

QUESTION_WORDS = frozenset(
    """
    a be of an in on do to or as is at it by had did and the are who for has was its but how why done were have
    with will whom from been when into does this that what where these those being which
    """.split()
)
"""Left out of a question's keywords when no language model splits it."""

NOT_ENTITIES = frozenset(
    """
    or and the who but how may why june here when this that what july there where these those march april august
    friday monday sunday section october chapter however tuesday january december november saturday thursday
    february therefore september wednesday
    """.split()
)
"""Capitalised single words that name nothing."""

ORGANISATION_ENDINGS = frozenset(
    ["company", "corporation", "group", "solutions", "technologies", "llc"] + [x + dot for x in ("corp", "inc", "ltd") for dot in ("", ".")]
)
ORGANISATION_BEGINNINGS = tuple(x + " of" for x in ("department", "institute", "university"))
PLACES = frozenset(["berlin", "boston", "california", "chicago", "london", "new york", "paris", "tokyo", "united states", "washington"])
TITLES = frozenset(["mr", "mrs", "ms", "dr", "prof"])
ABBREVIATIONS = TITLES | frozenset(["co", "corp", "etc", "inc", "jr", "llc", "ltd", "sr", "st", "vs"])
"""Words whose period ends a sentence only before a capital."""

TELLING_RELATIONS = frozenset(["BORN_IN", "COLLEAGUE_OF", "HEADQUARTERED_IN", "LEADS", "LOCATED_IN", "MARRIED_TO", "WORKS_FOR"])
"""Relation types that a later mention pair may put in place of a vaguer one."""
