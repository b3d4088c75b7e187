"""Constant tables.  Fixed values: they must equal the published ones for right results."""

from __future__ import annotations

# The dictionary that misspellings are matched against, in its order.
DICTIONARY = """
want have make take give think know feel become leave begin seem help show hear play run move live believe bring
happen write read learn change watch follow stop speak turn start might found going getting making coming looking
because really friend people school thought through enough should would could something anything everything different
important beautiful favorite probably actually definitely especially interesting tomorrow together people world thing
child children woman women place water money story point company problem game gaming setup computer phone video picture
awesome amazing cool minecraft fortnite youtube subscribe channel stream download update level character player
controller keyboard mouse monitor headset microphone camera screen desktop laptop good great little small large young
important different right wrong happy excited dyslexic very really always never sometimes usually i'm don't can't won't
it's that's there's what's let's didn't doesn't isn't aren't wasn't
""".split()

# Words that are never corrected.
VALID_WORDS = """
the a an is are was were be been being have has had do does did will would could should may might must shall can need
its it's i you he she it we they me him her us them my your his our their this that these those what which who whom and
or but if because when where how why for to of in on at by with from as go going went gone come coming came see saw
think know want get make take say said cool win won't kids never always reading writing hard easy words spelling
dyslexic platinum
""".split()

# Words whose exchange is a change of meaning, not of spelling.
MEANING_WORDS = """
first last next prev previous open close opens closes list lists update updates create creates delete deletes add adds
remove removes start stop starts stops read write reads writes send receive sends receives high low highest lowest left
right up down name names value values key keys type types file files path paths node nodes item items child parent
children parents sibling siblings true false null none empty full one two three four five single double triple excerpt
excerpts prime primer primes
""".split()

# Terms of programs, which no typo is mined from.
CODE_TERMS = """
get set has is on to str int bool arr obj func var val def cls src tgt tmp ptr idx len max min err msg buf ctx cfg env
api url uri sql css html xml json yaml http tcp udp
""".split()

# Groups of homophones and what each member means.
HOMOPHONE_GROUPS = [
    ["there", "their", "they're"], ["to", "too", "two"], ["your", "you're"], ["its", "it's"], ["here", "hear"],
    ["where", "wear", "were"], ["no", "know"], ["by", "buy", "bye"], ["right", "write"], ["which", "witch"],
]
DEFINITIONS = {
    "there": "a place (over there)", "their": "belonging to them", "they're": "they are (contraction)",
    "to": "direction (go to school)", "too": "also, or very much", "two": "the number 2",
    "your": "belonging to you", "you're": "you are (contraction)", "its": "belonging to it", "it's": "it is (contraction)",
    "here": "this place", "hear": "to listen with ears", "where": "asking about place", "wear": "to put on clothes",
    "were": "past tense of are", "no": "opposite of yes", "know": "to understand something",
    "by": "near, or done by someone", "buy": "to purchase something", "bye": "short for goodbye",
    "right": "correct, or direction", "write": "to put words on paper", "which": "asking about choice",
    "witch": "magical person in stories",
}

# Sentences that a misspelling takes turns in, and the texts of instructions.
SENTENCE_TEMPLATES = [
    "I have {} food.", "The {} is big.", "We went to the {}.", "She said {} to me.",
    "It was very {}.", "I want to {} today.", "The {} was great.", "He is my {}.",
]
WORD_INSTRUCTION = "Fix the spelling of this word."
SENTENCE_INSTRUCTION = "Fix the spelling mistakes in this sentence. Only output the corrected sentence."
CHANGES_INSTRUCTION = "Fix spelling mistakes. Output format: CHANGES: misspelled->correct"
CHAT_SYSTEM = "You are a spelling correction assistant. Fix spelling mistakes accurately."
CHANGES_TEMPLATES = {"have": 'Fix spelling: "I have {} here."', "the": 'Fix spelling: "The {} is here."'}
