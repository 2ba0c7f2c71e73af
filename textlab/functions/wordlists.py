"""Word tables used by the cleaning, lexicon and phrase operators.

Two kinds of table live here:

* fixed values that must equal the library behaviour the reference relies on
  (the standard English stop-word list, the slang table) -- stated plainly, in
  their natural order;
* our own small tables (sentiment lexicon, boosters, negations, lemmas).  No
  public lexicon can be fetched offline, so these are ours; every scorer takes
  the table as a parameter so a user can pass a full lexicon instead.
"""

from __future__ import annotations

# --- Fixed values: the standard English stop-word list (179 words), in its
# --- published order.
ENGLISH_STOP_WORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your "
    "yours yourself yourselves he him his himself she she's her hers herself it "
    "it's its itself they them their theirs themselves what which who whom this "
    "that that'll these those am is are was were be been being have has had "
    "having do does did doing a an the and but if or because as until while of "
    "at by for with about against between into through during before after "
    "above below to from up down in out on off over under again further then "
    "once here there when where why how all any both each few more most other "
    "some such no nor not only own same so than too very s t can will just don "
    "don't should should've now d ll m o re ve y ain aren aren't couldn couldn't "
    "didn didn't doesn doesn't hadn hadn't hasn hasn't haven haven't isn isn't "
    "ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn "
    "shouldn't wasn wasn't weren weren't won won't wouldn wouldn't"
).split()

# --- Fixed values: extra stop words of the LDA cleaning chain.
LDA_EXTRA_STOP_WORDS = ["from", "subject", "re", "edu", "use"]

# --- Fixed values: slang table of the lexicon-polarity script, in its natural
# --- order (duplicates included; a later duplicate keeps the first position).
SLANG_TABLE = [
    ("idc", "I don't care"), ("lol", "laugh out loud"), ("btw", "by the way"),
    ("omg", "oh my god"), ("brb", "be right back"), ("jk", "just kidding"),
    ("tbh", "to be honest"), ("afaik", "as far as I know"), ("imo", "in my opinion"),
    ("fomo", "fear of missing out"), ("imo", "in my opinion"), ("hmu", "hit me up"),
    ("omw", "on my way"), ("wtf", "what the f***"), ("rn", "right now"),
    ("tbt", "throwback Thursday"), ("bff", "best friends forever"),
    ("fwiw", "for what it's worth"), ("ikr", "I know, right?"),
    ("icymi", "in case you missed it"), ("smh", "shake my head"), ("nvm", "nevermind"),
    ("tmi", "too much information"), ("imho", "in my humble opinion"),
    ("fyi", "for your information"), ("gtg", "got to go"), ("np", "no problem"),
    ("btw", "by the way"), ("yw", "you're welcome"), ("gg", "good game"),
    ("gr8", "great"), ("thx", "thanks"), ("omg", "oh my god"), ("jk", "just kidding"),
    ("np", "no problem"), ("pls", "please"), ("rly", "really"), ("u", "you"),
    ("ur", "your"), ("yr", "year"), ("tho", "though"), ("thru", "through"),
    ("b4", "before"), ("cuz", "because"), ("wanna", "want to"), ("gonna", "going to"),
    ("gotta", "got to"), ("kinda", "kind of"), ("sorta", "sort of"), ("lemme", "let me"),
    ("gimme", "give me"), ("ain't", "am not / is not / are not"), ("gon", "going to"),
    ("ya", "you"), ("nbd", "no big deal"), ("fam", "family"), ("sry", "sorry"),
    ("probs", "probably"), ("thx", "thanks"), ("thnx", "thanks"), ("yo", "hey"),
    ("dope", "excellent"), ("lit", "awesome"), ("sick", "cool"), ("legit", "legitimate"),
    ("bruh", "bro"), ("hella", "very"), ("g2g", "got to go"), ("omw", "on my way"),
    ("bday", "birthday"), ("af", "as f***"), ("tgif", "thank goodness it's Friday"),
    ("meh", "indifferent"), ("fomo", "fear of missing out"), ("hmu", "hit me up"),
    ("ik", "I know"), ("idk", "I don't know"), ("irl", "in real life"),
    ("ttyl", "talk to you later"), ("wb", "welcome back"), ("yolo", "you only live once"),
    ("bff", "best friends forever"), ("fb", "Facebook"), ("ig", "Instagram"),
    ("iggy", "I guess"), ("insta", "Instagram"), ("lmao", "laughing my ass off"),
    ("lmfao", "laughing my f***ing ass off"), ("rofl", "rolling on the floor laughing"),
    ("smh", "shake my head"), ("stfu", "shut the f*** up"), ("tmi", "too much information"),
    ("ttyl", "talk to you later"), ("wth", "what the hell"), ("omg", "oh my god"),
    ("wtf", "what the f***"), ("gtfo", "get the f*** out"), ("jk", "just kidding"),
    ("jk lol", "just kidding, laugh out loud"), ("np", "no problem"),
    ("npnp", "no problem, no problem"), ("pls", "please"), ("plz", "please"),
    ("sry", "sorry"), ("thx", "thanks"), ("thnx", "thanks"), ("ty", "thank you"),
    ("tyvm", "thank you very much"), ("yw", "you're welcome"),
]


def slang_pairs() -> list[tuple[str, str]]:
    """Distinct keys in first-seen order, as a Python dict literal keeps them."""
    return list(dict(SLANG_TABLE).items())


# --- Our own sentiment lexicon (word -> valence on a -4..4 scale).  The
# --- insults are the affect words that occur in the driver corpus; the small
# --- values on frequent function words make the scores vary on invented prose.
LEXICON = {
    "trash": -2.0, "clown": -1.5, "idiot": -2.0, "scum": -2.5, "worthless": -2.0,
    "moron": -2.2, "pathetic": -2.1, "loser": -1.8, "stupid": -1.5, "disgusting": -2.4,
    "bad": -2.5, "hate": -2.7, "awful": -2.0, "terrible": -2.1, "sad": -2.1,
    "wrong": -2.1, "poor": -2.1, "angry": -2.3, "ugly": -2.3, "sick": -1.9,
    "good": 1.9, "great": 3.1, "love": 3.2, "nice": 1.8, "happy": 2.7,
    "excellent": 2.7, "best": 3.2, "like": 1.5, "thanks": 1.9, "cool": 1.3,
    "awesome": 3.1, "fun": 2.3, "glad": 2.0, "wonderful": 2.7, "amazing": 2.8,
    "with": 0.6, "that": 0.5, "was": -0.4, "be": -0.3, "this": 0.3,
    "and": 0.2, "the": -0.1, "on": 0.2, "by": -0.2, "for": 0.4,
}

# Idioms and special cases published with the rule-based sentiment scorer (fixed values).
IDIOMS = {
    "the bomb": 3.0, "bad ass": 1.5, "bus stop": 0.0, "yeah right": -2.0, "kiss of death": -1.5,
    "to die for": 3.0, "beating heart": 3.1, "broken heart": -2.9,
    "cut the mustard": 2.0, "hand to mouth": -2.0, "back handed": -2.0, "blow smoke": -2.0,
    "upper hand": 1.0, "break a leg": 2.0, "cooking with gas": 2.0, "in the black": 2.0,
    "in the red": -2.0, "on the ball": 2.0, "under the weather": -2.0,
}

# The minimum-slice lexicon (a subset of the one above), used by the fixture test.
SLICE_LEXICON = {
    "trash": -2.0, "clown": -1.5, "idiot": -2.0, "scum": -2.5, "worthless": -2.0,
    "stupid": -1.5, "with": 0.6, "that": 0.5, "was": -0.4, "be": -0.3,
}

# Our own negation words (lower case).  Contractions are listed without their
# apostrophe; the scorers also take every word with "n't" as a negation.
NEGATIONS = [
    "not", "no", "never", "none", "nobody", "nothing", "neither", "nor", "nowhere",
    "cannot", "without", "isnt", "arent", "dont", "doesnt", "didnt", "wasnt", "werent",
    "cant", "couldnt", "wont", "wouldnt", "shouldnt", "hasnt", "havent", "hadnt",
    "mustnt", "neednt", "aint",
]

# Our own intensity modifiers: word -> +1 (booster) or -1 (dampener).
BOOSTERS = {
    "very": 1, "really": 1, "extremely": 1, "so": 1, "totally": 1, "absolutely": 1,
    "completely": 1, "incredibly": 1, "highly": 1, "most": 1, "truly": 1, "too": 1,
    "slightly": -1, "barely": -1, "hardly": -1, "somewhat": -1, "marginally": -1,
    "less": -1, "little": -1, "partly": -1,
}

# Our own multiplicative intensifiers for the polarity scorer.
INTENSIFIERS = {
    "very": 1.3, "really": 1.2, "extremely": 1.5, "so": 1.2, "totally": 1.3,
    "absolutely": 1.4, "completely": 1.3, "incredibly": 1.4, "highly": 1.2,
    "slightly": 0.7, "barely": 0.6, "somewhat": 0.8,
}

# Our own small lemma table: (word, lemma, part of speech).  Words absent from
# the table keep their form and count as NOUN (the open class).
LEMMAS = [
    ("i", "i", "PRON"), ("you", "you", "PRON"), ("he", "he", "PRON"), ("she", "she", "PRON"),
    ("it", "it", "PRON"), ("we", "we", "PRON"), ("they", "they", "PRON"),
    ("this", "this", "DET"), ("that", "that", "DET"), ("these", "these", "DET"),
    ("those", "those", "DET"), ("a", "a", "DET"), ("an", "an", "DET"), ("the", "the", "DET"),
    ("and", "and", "CCONJ"), ("or", "or", "CCONJ"), ("but", "but", "CCONJ"),
    ("of", "of", "ADP"), ("in", "in", "ADP"), ("on", "on", "ADP"), ("by", "by", "ADP"),
    ("with", "with", "ADP"), ("for", "for", "ADP"), ("at", "at", "ADP"), ("to", "to", "PART"),
    ("is", "be", "AUX"), ("are", "be", "AUX"), ("was", "be", "AUX"), ("were", "be", "AUX"),
    ("be", "be", "AUX"), ("been", "be", "AUX"), ("am", "be", "AUX"),
    ("has", "have", "VERB"), ("had", "have", "VERB"), ("have", "have", "VERB"),
    ("does", "do", "VERB"), ("did", "do", "VERB"), ("done", "do", "VERB"),
    ("went", "go", "VERB"), ("gone", "go", "VERB"), ("goes", "go", "VERB"),
    ("made", "make", "VERB"), ("makes", "make", "VERB"), ("said", "say", "VERB"),
    ("says", "say", "VERB"), ("took", "take", "VERB"), ("taken", "take", "VERB"),
    ("came", "come", "VERB"), ("comes", "come", "VERB"), ("saw", "see", "VERB"),
    ("seen", "see", "VERB"), ("got", "get", "VERB"), ("gets", "get", "VERB"),
    ("knew", "know", "VERB"), ("known", "know", "VERB"), ("thought", "think", "VERB"),
    ("felt", "feel", "VERB"), ("found", "find", "VERB"), ("gave", "give", "VERB"),
    ("told", "tell", "VERB"), ("became", "become", "VERB"), ("left", "leave", "VERB"),
    ("people", "person", "NOUN"), ("men", "man", "NOUN"), ("women", "woman", "NOUN"),
    ("children", "child", "NOUN"), ("feet", "foot", "NOUN"), ("teeth", "tooth", "NOUN"),
    ("mice", "mouse", "NOUN"), ("users", "user", "NOUN"), ("posts", "post", "NOUN"),
    ("tweets", "tweet", "NOUN"), ("flavors", "flavor", "NOUN"), ("vapes", "vape", "NOUN"),
    ("cigarettes", "cigarette", "NOUN"), ("kids", "kid", "NOUN"), ("days", "day", "NOUN"),
    ("years", "year", "NOUN"), ("things", "thing", "NOUN"), ("words", "word", "NOUN"),
    ("better", "good", "ADJ"), ("best", "good", "ADJ"), ("worse", "bad", "ADJ"),
    ("worst", "bad", "ADJ"), ("good", "good", "ADJ"), ("bad", "bad", "ADJ"),
    ("very", "very", "ADV"), ("really", "really", "ADV"), ("not", "not", "PART"),
    ("never", "never", "ADV"), ("often", "often", "ADV"),
]

ALLOWED_POS = ("NOUN", "ADJ", "VERB", "ADV")
