"""Abusive, hateful and sexual language, by a weighted finite-state pattern grammar.

Four transducers are composed, each working on whole sentences, never on isolated words:

1. lexicon: surface tokens to sets of word classes, undoing disguises (zero-width and look-alike letters, digits for
   letters, stretched letters, letters set apart, letters masked by stars);
2. clauses: a target (the person spoken to, a third person, a group) composed with a predicate (copula, address, comparison,
   act, wish) and an offence class, with modifiers or bounded gaps between, to weighted tags (insult, threat, sexual, hate);
3. negation: a match whose offence is negated between target and word doesn't count;
4. reported speech: a match inside a quotation or list that the sentence reports, forbids or removes doesn't count, nor
   one in a sentence on which wordings a rule forbids.

The clauses name grammatical patterns, each built from parts (``PARTS``) that several of them share; words stand only in the
classes, four languages side by side. Anger at things has no target, remarks about oneself have the wrong one, and verbs with
an innocent sense count only with a body as object or nothing behind the person.

A clause gives its tag once in a sentence, if any of its matches counts.
A sentence's score is the sum of its tags, a document's the highest of its sentences. 1 is the mark for abuse.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = 1.0

#: The words of each class (English, German, Spanish, French), without accents; ``+`` adds the plural in s.
CLASSES: dict[str, str] = {
    # targets
    "YOU": "you u ya yall du ihr tu te ti vous vosotros usted ustedes", "YOUR": "your ur dein deine deinen deiner deinem eure tu tus ta ton tes votre vos vuestro", "YOURS": "yours you your",
    "HE": "he she er ella elle", "HIM": "him her them", "THEY": "they those these sie ellos ellas ils elles", "WHO": "whoever", "DET": "the this that these those every some der die das dieser el la los las le les ce cette",
    "PERSON": "author+ reviewer+ maintainer+ developer+ dev+ programmer+ coder+ colleague+ coworker+ manager+ boss engineer+ intern+ guy+ man woman girl+ boy+ dude+ person contributor+ committer+ teammate+ moderator+ admin+ autor autora kollege chef jefe auteur collegue",
    "GROUPS": "woman women men gays lesbian+ immigrant+ migrant+ foreigner+ refugee+ believer+ atheist+ jew+ muslim+ christian+ hindu+ black+ white+ asian+ african+ arab+ mexican+ gypsy gypsies native+ peasant+ southerner+ northerner+ pensioner+ "
    "frauen manner auslander fluchtlinge juden muslime schwule zigeuner mujeres inmigrantes extranjeros judios gitanos negros femmes immigres etrangers juifs arabes musulmans homosexuals cripples",
    "GROUPADJ": "gay lesbian trans transgender disabled old elderly young black white brown asian african arab jewish muslim christian foreign deaf blind autistic poor homeless religious", "PEOPLE": "people folk+ person+ men women guys kids employees workers developers leute gente gens",
    "FROM": "from", "ALL": "all every these those alle todos todas tous toutes the", "OF": "of de d",
    # grammar
    "I": "i we ich wir yo nosotros je nous someone somebody", "ME": "me us mir mich mi moi", "MY": "my mein meinem meinen mi mis mon ma mes",
    "BE": "are re r is s be am m were was being been bist seid sind ist eres es son sois esta estas suis sont etes est", "BETWO": "eres sois bist seid",
    "WILL": "will ll shall gonna going should would want must werde werden wird voy vamos vais vas could ought", "TO": "to", "ONLY": "only nur solo seul seule", "WOULD": "would could can will",
    "NEG": "not no never nobody nicht kein keine nunca pas jamais isnt arent wasnt werent aint dont doesnt didnt wont cannot cant", "CANT": "cannot cant not", "NEVER": "never nie nunca jamais",
    "MOD": "a an the such some complete completely total totally absolute absolutely real really utter utterly just so too very quite pretty bloody damn damned fucking freaking goddamn little big nothing but always clearly obviously truly still "
    "ein eine einen einem kompletter komplette totaler totale echter echte wirklich zu sehr nur un una unos unas tan muy completo completa verdadero une des si tres vrai vraie plain proper",
    "HARDMOD": "complete total absolute real utter bloody damn damned fucking freaking goddamn little fat ugly old lousy kompletter totaler verdadero vrai", "LIKE": "like wie como comme", "THAN": "than als que", "THAT": "that those their this",
    # insults
    "INSULT": "idiot+ moron+ imbecile+ cretin+ halfwit+ dimwit+ nitwit+ dunce+ dumbass asshole+ dickhead+ prick+ wanker+ cunt+ whore+ slut+ bitch bitches bastard+ retard+ scumbag+ simpleton+ buffoon+ fool+ loser+ coward+ douchebag+ motherfucker+ shithead+ twat+ "
    "jackass tosser+ jerk+ scum vermin subhuman+ maggot+ cockroach halfbrain airhead+ vollidiot trottel versager depp dummkopf arschloch vollpfosten penner abschaum hurensohn wichser idiota idiotas imbecil imbeciles gilipollas cabron payaso mierda escoria "
    "zorra puta tonto estupido estupida cretino abruti abrutie connard connasse ordure debile imbecilite salope encule",
    "BEAST": "pig+ rat+ clown+ worm+ leech leeches parasite+ snake+ cow+ donkey+ weasel+ swine dog+ ape+ toad+ cockroach cockroaches pest+ schwein ratte hund cerdo rata perro porc", "RUBBISH": "trash garbage filth dirt rubbish joke failure disgrace embarrassment disease cancer plague mull dreck basura asco dechet dechets inutil nul minable",
    "DEROG": "stupid brainless worthless pathetic dumb mindless moronic idiotic braindead retarded incompetent disgusting filthy ugly fat useless pitiful spineless gutless clueless ignorant inbred repulsive subhuman inferior dumm erbarmlich erbarmlicher "
    "nutzlos widerlich hasslich unfahig blod bloder estupido estupida tonto tonta inutil patetico asqueroso asquerosa stupide inutile nul minable pathetique debile repugnant",
    "DULL": "dim slow thick dense dumb stupid lazy simple", "TOO": "too zu demasiado trop", "BASE": "breathe live exist think read count spell tie walk talk code survive",
    "DEHUMAN": "vermin subhuman subhumans animals rats cockroaches scum filth parasites maggots apes pests plague disease trash garbage dirt monkeys savages ungeziefer abschaum dreck escoria basura ratas animales vermine ordures", "DEHUMANHARD": "vermin subhuman subhumans cockroaches scum parasites maggots ungeziefer escoria vermine",
    "HEY": "listen hey oi hor ecoute oye yo", "KIND": "kind sort type", "WHAT": "what que quel was", "WASTE": "waste", "AIR": "oxygen space air breath skin time", "PIECE": "piece pedazo stuck sack bag load", "ESPECE": "espece",
    "SHUT": "shut", "UP": "up", "GAGVERB": "halt halts ferme fermez cierra cerra", "GAG": "fresse maul klappe schnauze gueule boca hocico bec", "HUSH": "callate callaos", "SCRAM": "verschwinde verpiss degage degagez largate vete casse", "OFF": "off", "DAMNVERB": "fuck screw piss sod bugger",
    "SICKEN": "disgust disgusts sicken sickens repulse repulses revolt", "ASCO": "asco", "LOATHE": "hate hates despise despises loathe loathes hasse hassen odio odia deteste", "LOVE": "likes loves wants misses needs quiere mag liebt aime veut", "NOONE": "nobody noone nadie niemand personne no", "EVERYONE": "everyone everybody alle todos",
    "BRAIN": "brain brains mind iq", "PARENTS": "parents mother father mum mom dad family", "ASHAMED": "ashamed embarrassed", "PRAISE": "kindest nicest best politest", "THING": "thing things", "ABOUT": "about", "BLAME": "reason problem cancer disease proof curse",
    "LESSER": "houseplant+ monkey+ potato potatoes brick+ rock+ toddler+ chimp+ goldfish hamster+ toaster+ parrot+ doorknob+ turnip+ cabbage+ ape+ baby babies dog+ cat+ chicken+ pigeon+ sloth+", "MORE": "more better smarter faster brighter cleverer", "WIT": "talent brains brain sense skill intelligence taste iq clue",
    # threats
    "MAIM": "kill murder stab strangle choke punch slap hurt smash butcher slaughter umbringen toten matar matare tuer", "STRIKE": "break beat burn cut crush destroy end hit shoot hunt bury finish smash kick punch twist rip snap brechen romper", "SOFT": "up at in to a an the on back with over for some out by",
    "BODY": "finger+ bone+ neck+ leg+ arm+ face+ teeth tooth skull+ head+ throat+ knee+ nose+ hand+ rib+ jaw+ spine+ eye+ knochen finger hals piernas cuello", "SELF": "yourself yourselves dich", "KNOW": "know knows find found learn weiss se sais", "WHERE": "where wo donde ou", "LAIR": "live lives sleep work park stay hide wohnst vives habites drive",
    "KIN": "kids kid children child family wife husband daughter son mother mum mom sister brother girlfriend boyfriend kinder hijos", "GO": "go goes live lives play sleep attend attends study are", "WATCH": "watch", "BACK": "back", "EXIT": "leave leaves go end finish wake carried", "IN": "in on inside", "WRECK": "ambulance coffin hospital stretcher wheelchair hearse bodybag casket morgue grave box",
    "SHOVE": "push throw shove kick toss hang drop", "FALL": "down off under out through into from", "STAIRS": "stair+ staircase stairwell bridge roof cliff window balcony train building", "MISS": "notice miss care mourn cry mind", "VANISH": "vanished vanish disappeared disappear died die drowned drown gone", "WORLD": "world everyone everybody us humanity yourself", "FAVOUR": "favour favor",
    "HOPE": "hope wish", "DIE": "die rot suffer burn choke drown vanish disappear", "WAKE": "wake", "DEAD": "dead", "BETTER": "better", "WITHOUT": "without",
    # sexual
    "SEND": "send show give text", "NUDES": "nudes tits titties boobs pussy dick panties underwear", "NAKED": "naked nude undressed topless", "SHOT": "picture+ photo+ pic+ image+ selfie+ body", "THINK": "thinking think dreaming dream imagine imagining fantasize fantasizing picturing", "HORNY": "horny aroused", "MAKE": "makes make made gets get getting",
    "SIT": "sit sits ride", "LAP": "lap face cock dick", "RIP": "rip tear", "TAKE": "take pull get strip", "CLOTHES": "clothes dress skirt blouse shirt pants bra panties trousers", "SUCK": "suck lick", "PRIVATE": "dick cock pussy balls ass arse tits boobs", "FUCK": "fuck bang screw grope fondle rape", "ADMIRE": "love grab squeeze touch want spank nice hot sexy great perfect", "RUMP": "ass butt breasts tits boobs cleavage curves",
    "MOAN": "moan moaning", "SWEET": "sweetheart darling baby honey sexy babe",
    # hate
    "DEPORT": "send throw kick deport ship get drive", "HOME": "back home out", "KEEP": "keep kept ban bar", "OUT": "out away", "ERASE": "gassed shot exterminated killed deported eliminated burned burnt hanged sterilized sterilised lynched locked wiped euthanized drowned caged", "SHOULD": "should must deserve ought to gehoren", "DEATH": "death gas exterminate lynch", "LET": "let allow allowed", "NEAR": "near in into touch around at",
    "TYPICAL": "typical", "ONE": "one", "THINKS": "think reason code learn read understand drive work", "PARASITIC": "breed breeding beg steal multiply leech stink lie",
    # reported speech
    "SAY": "call calling called say saying write writing use using", "REPORT": "reading reads wrote written said removed deleted banned forbidden blocked blocklist filter moderators moderator moderated flagged reported quoted quote rule rules guideline policy example list listed words word term terms phrase comment",
    "UTTERANCE": "comment comments message messages remark remarks phrase phrases sentence sentences wording word words term terms insult insults slur slurs string strings language", "FORBID": "forbidden banned removed deleted blocked disallowed prohibited unacceptable flagged rejected moderated filtered violates violate against allowed",
}

#: Parts that clauses share; each stands for any of its alternatives.
PARTS: dict[str, list[str]] = {
    "third": ["HE BE", "DET PERSON ~4 BE", "WHO ~4 BE"],
    "group": ["GROUPS", "GROUPADJ PEOPLE", "PEOPLE FROM ~2", "GROUPS FROM ~2"],
    "low": ["INSULT", "BEAST"],
    "whom": ["YOU", "HIM"],
    "lesser": ["YOU", "HIM", "DET PERSON", "GROUPS", "GROUPADJ PEOPLE", "PEOPLE FROM"],
}

#: The clauses: classes in order; "~n" allows up to n tokens between, "*X" up to four tokens of a class (MOD means DEROG too), "-X" wants
#: no token of a class next, "<part>" any of its alternatives; "!" marks where a negation lifts the tag.
CLAUSES: list[tuple[str, float, str]] = [
    # copula and address
    ("insult", 1.0, "YOU BE *MOD <low> !"), ("insult", 1.0, "YOU BE *MOD RUBBISH !"), ("insult", 1.0, "YOU BE *MOD DEROG !"), ("insult", 1.0, "YOU ~2 BE *MOD INSULT !"), ("insult", 1.0, "BETWO *MOD <low> !"), ("insult", 1.0, "BETWO *MOD DEROG !"),
    ("insult", 1.0, "BE YOU *MOD INSULT"), ("insult", 1.0, "BE YOU *MOD DEROG"), ("insult", 1.0, "<third> *MOD INSULT !"), ("insult", 1.0, "HE BE *MOD BEAST !"), ("insult", 1.0, "HE BE *MOD DEROG !"),
    ("insult", 1.0, "YOU *MOD INSULT"), ("insult", 1.0, "YOU *MOD HARDMOD *MOD BEAST -DET"), ("insult", 1.0, "YOU *MOD DEROG *MOD BEAST -DET"), ("insult", 1.0, "HEY ~1 <low>"), ("insult", 1.0, "SHUT UP ~1 *MOD <low>"),
    ("insult", 1.0, "KIND OF *MOD <low>"), ("insult", 1.0, "WHAT *MOD INSULT"), ("insult", 1.0, "ONLY *MOD <low> WOULD"), ("insult", 1.0, "ESPECE OF *MOD <low>"), ("insult", 1.0, "YOU *MOD PIECE OF ~1 INSULT"), ("insult", 1.0, "YOU *MOD PIECE OF RUBBISH"),
    ("insult", 1.0, "HUSH ~2 PIECE OF RUBBISH"), ("insult", 1.0, "HUSH ~2 PIECE OF INSULT"), ("insult", 1.0, "YOU BE *MOD WASTE OF AIR !"), ("insult", 1.0, "HE BE *MOD WASTE OF AIR !"), ("insult", 1.0, "TOO DEROG TO BASE"),
    # dismissal, disgust, contempt
    ("insult", 0.7, "SHUT UP"), ("insult", 1.0, "GAGVERB ~1 GAG"), ("insult", 0.7, "HUSH"), ("insult", 0.5, "SCRAM"), ("insult", 1.0, "DAMNVERB YOU -SOFT"), ("insult", 0.7, "DAMNVERB OFF"),
    ("insult", 1.0, "YOU SICKEN ME !"), ("insult", 0.5, "ASCO"), ("insult", 1.0, "NOONE ~1 YOU LOVE"), ("insult", 1.0, "NOONE LOVE YOU"), ("insult", 1.0, "EVERYONE ~1 LOATHE YOU !"), ("insult", 1.0, "I LOATHE YOU -SOFT !"),
    ("insult", 1.0, "BRAIN LIKE YOURS"), ("insult", 1.0, "PEOPLE LIKE YOU BE ~1 BLAME"), ("insult", 1.0, "YOUR PARENTS ~2 ASHAMED"), ("insult", 1.0, "PRAISE THING ~5 ABOUT <whom>"),
    ("insult", 1.0, "LESSER ~8 MORE ~1 WIT THAN ~1 <lesser>"), ("insult", 1.0, "LESSER ~8 MORE THAN <lesser>"),
    # threats
    ("threat", 1.0, "I ~1 WILL *WILL ~2 MAIM <whom> -SOFT !"), ("threat", 1.0, "I ~1 WILL *WILL ~2 STRIKE <whom> -SOFT !"), ("threat", 1.0, "I ~1 WILL *WILL ~2 MAIM YOUR ~1 BODY !"), ("threat", 1.0, "I ~1 WILL *WILL ~2 STRIKE YOUR ~1 BODY !"), ("threat", 1.0, "I ~1 WILL *WILL ~2 MAIM YOUR ~1 KIN !"),
    ("threat", 1.0, "KNOW ~1 WHERE YOU ~1 LAIR -FROM"), ("threat", 1.0, "KNOW ~1 WHERE YOUR ~1 KIN ~1 GO"), ("threat", 1.0, "WATCH YOUR BACK"), ("threat", 1.0, "YOU WILL ~2 EXIT ~4 IN ~1 WRECK !"),
    ("threat", 1.0, "SHOVE <whom> ~1 FALL ~2 STAIRS !"), ("threat", 1.0, "NOONE ~6 MISS ~2 YOU ~1 VANISH"), ("threat", 1.0, "WORLD ~2 FAVOUR ~10 DIE"), ("threat", 1.0, "WORLD ~2 FAVOUR ~10 NEVER WAKE"),
    ("threat", 1.0, "MAIM SELF !"), ("threat", 1.0, "SHOVE SELF !"), ("threat", 1.0, "HOPE <whom> ~2 DIE !"), ("threat", 1.0, "HOPE YOU ~1 NEVER WAKE"), ("threat", 1.0, "BETTER ~1 WITHOUT YOU IN"), ("threat", 1.0, "YOU ~2 BETTER OFF DEAD"),
    # sexual
    ("sexual", 1.0, "SEND ME ~2 NUDES !"), ("sexual", 1.0, "SEND ME ~2 NAKED SHOT !"), ("sexual", 1.0, "THINK ~1 <whom> ~1 NAKED"), ("sexual", 1.0, "MAKE ME ~1 HORNY"), ("sexual", 1.0, "SIT ~2 MY LAP"), ("sexual", 1.0, "RIP ~1 YOUR CLOTHES"), ("sexual", 1.0, "TAKE YOUR CLOTHES OFF"),
    ("sexual", 1.0, "SUCK MY ~1 PRIVATE"), ("sexual", 1.0, "I ~1 WILL *WILL ~1 FUCK <whom> -FALL !"), ("sexual", 1.0, "ADMIRE ~1 YOUR ~1 RUMP"), ("sexual", 0.5, "YOU MOAN"), ("sexual", 0.5, "SWEET"), ("sexual", 0.5, "YOU NAKED"),
    # hate
    ("hate", 1.0, "<group> BE *MOD DEHUMAN !"), ("hate", 1.0, "<group> BE *MOD <low> !"), ("hate", 1.0, "<group> BE *MOD DEROG !"), ("hate", 1.0, "THEY BE *MOD DEHUMANHARD !"), ("hate", 1.0, "DEPORT ~2 <group> -BE ~4 HOME"), ("hate", 0.7, "KEEP ~1 <group> ~2 OUT"),
    ("hate", 1.0, "<group> ~1 SHOULD ~1 BE ~1 ERASE !"), ("hate", 1.0, "MAIM ALL <group> !"), ("hate", 1.0, "DEATH *ALL *TO *ALL <group> !"), ("hate", 0.7, "NEVER ~2 LET ~1 <group> ~2 NEAR"), ("hate", 1.0, "TYPICAL ~1 <group> ~2 TOO DULL"), ("hate", 0.7, "<group> CANT ~1 THINKS"),
    ("hate", 0.5, "ONE OF THAT <group>"), ("hate", 0.5, "THAT KIND CANT ~1 THINKS"), ("hate", 0.7, "THEY ~1 ONLY ~1 PARASITIC"),
]

#: Letters that look like Latin ones, and digits or signs written for letters.
_LOOKALIKE = str.maketrans("авеорсухіјѕкмтнԁɡαοερνικ", "abeopcyxijskmthdgaoepvik")
_DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

_HIDDEN = re.compile("[​-‏⁠­﻿᠎]")
_APART = re.compile(r"(?<![\w.*])[^\W\d_](?:([ .\-·_*])[^\W\d_])(?:\1[^\W\d_])+(?![\w*])")
_TOKEN = re.compile(r"[^\W_](?:[\w*@$]*[^\W_])?['’]?[^\W\d_]*")
_END = re.compile(r"(?<=[.!?…])[\s\"'”»)]+|[\r\n]+")
_QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|«[^»]*»|`[^`]*`|„[^“”]*[“”]")
_PLAIN = re.compile(r"[a-z]+")
_CONTRACTED = re.compile(r"(?<=[^\W\d_])['’](?!t$)(?=[^\W\d_])")
_EXAMPLES = re.compile(r"\b(?:such as|like|e\.g\.|for example|including|saying|containing)\b")


def _listing(s: str) -> bool:
    """Whether a sentence introduces examples, here of what it forbids."""
    return _EXAMPLES.search(s) is not None


def _strip_accents(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def _squash(s: str) -> str:
    return re.sub(r"(.)\1+", r"\1", s)


def _runs(s: str) -> list[int]:
    return [len(m[0]) for m in re.finditer(r"(.)\1*", s)]


class Lexicon:
    """Surface token to a bit set of word classes."""

    def __init__(self) -> None:
        self.bit = {name: 1 << i for i, name in enumerate(CLASSES)}
        self.exact: dict[str, int] = Counter()
        for name, words in CLASSES.items():
            for w in _strip_accents(words).split():
                self.exact[w.rstrip("+")] |= self.bit[name]
                if w[-1] == "+":
                    self.exact[w[:-1] + "s"] |= self.bit[name]
        self.exact = dict(self.exact)
        self.squashed: dict[str, list[tuple[list[int], int]]] = {}
        for w, m in self.exact.items():
            self.squashed.setdefault(_squash(w), []).append((_runs(w), m))
        self.masks: dict[tuple[str, str, int], int] = {}
        for w, m in self.exact.items():
            if len(w) > 3:
                k = (w[0], w[-1], len(w))
                self.masks[k] = self.masks.get(k, 0) | m
        self.classes = lru_cache(maxsize=200_000)(self._classes)

    def _stretched(self, t: str) -> int:
        """The classes of the words that ``t`` is when letters are drawn out: none of its runs is shorter than the word's."""
        runs, mask = _runs(t), 0
        for own, m in self.squashed.get(_squash(t), ()):
            if all(a >= b for a, b in zip(runs, own)):
                mask |= m
        return mask

    def _classes(self, token: str) -> int:
        t = token.replace("’", "'")
        m = self.exact.get(t, 0)
        if m or _PLAIN.fullmatch(t) and not re.search(r"(.)\1", t):
            return m
        if "'" in t:
            return self._classes(t.replace("'", ""))
        t = _strip_accents(t.translate(_LOOKALIKE))
        if "*" in t:
            if re.fullmatch(r"[a-z]\*+[a-z]", t):
                return self.masks.get((t[0], t[-1], len(t)), 0)
            return 0
        if re.search(r"[\d@$!]", t) and re.search(r"[a-z]", t) or re.fullmatch(r"[0-9]{4,}", t):
            if not re.search(r"[a-z]", t):
                return 0
            for one in "il":
                word = "".join(_DIGITS.get(c, c) if c != "1" else one for c in t)
                m = self.exact.get(word, 0) or self._stretched(word)
                if m:
                    return m
            return 0
        return self.exact.get(t, 0) or (self._stretched(t) if re.search(r"(.)\1", t) else 0)


#: Most modifiers in a row.
_MODIFIERS = 4


def _alternatives(text: str) -> Iterator[list[str]]:
    """A clause with its parts written out, one list of steps for each choice."""
    options = [PARTS[p[1:-1]] if p[0] == "<" else [p] for p in text.split()]
    for choice in itertools.product(*options):
        yield " ".join(choice).split()


class Clauses:
    """The clause transducer: weighted finite automata over class sets, one path for each way of writing a clause out."""

    def __init__(self, bit: dict[str, int]) -> None:
        self.paths = []
        self.key: dict[int, list[int]] = {}
        common = {c for c in "YOU YOUR YOURS HE HIM THEY WHO DET PEOPLE FROM ALL OF I ME MY BE WILL TO ONLY WOULD NEG CANT NEVER MOD LIKE THAN THAT WHAT UP OFF ABOUT THING MORE BACK IN GO SOFT OUT HOME ONE KIND MAKE TAKE GROUPADJ KNOW SAY".split()}
        for n, (tag, weight, text) in enumerate(CLAUSES):
            for parts in _alternatives(text):
                steps, need = [], 0
                for p in parts:
                    name = p.lstrip("*-")
                    mask = bit.get(name, 0) | (bit["DEROG"] if p == "*MOD" else 0)
                    if p[0] == "~":
                        steps.append(("gap", int(p[1:])))
                    elif p[0] in "*-":
                        steps.append(("some" if p[0] == "*" else "none", mask))
                    elif p != "!":
                        steps.append(("one", mask))
                        need |= mask
                rare = [bit[p] for p in parts if p in bit and p not in common] or [bit[p] for p in parts if p in bit]
                self.paths.append((n, tag, weight, steps, need, "!" in parts))
                self.key.setdefault(rare[-1], []).append(len(self.paths) - 1)
        self.offence = 0
        for k in self.key:
            self.offence |= k

    def run(self, lattice: list[int], held: int) -> Iterator[tuple[int, str, float, bool, Iterator[tuple[int, int]]]]:
        """(clause, tag, weight, liftable, matches) of every path whose classes a sentence's lattice holds."""
        for key, paths in self.key.items():
            if held & key:
                for i in paths:
                    n, tag, weight, steps, need, lifted = self.paths[i]
                    if held & need == need:
                        yield n, tag, weight, lifted, self._matches(lattice, steps)

    @staticmethod
    def _matches(lattice: list[int], steps: list[tuple[str, int]]) -> Iterator[tuple[int, int]]:
        """(from, to) of the matches of a path, for each start the shortest: what lies in it lies in all others from there,
        so if the shortest is negated or reported, they all are."""
        first, size = steps[0][1], len(lattice)
        for start, mask in enumerate(lattice):
            if not mask & first:
                continue
            ends = {start + 1}
            for kind, arg in steps[1:]:
                if kind == "one":
                    ends = {e + 1 for e in ends if e < size and lattice[e] & arg}
                elif kind == "gap":
                    ends = {k for e in ends for k in range(e, min(e + arg, size) + 1)}
                elif kind == "some":
                    new = set(ends)
                    for e in ends:
                        while e < size and lattice[e] & arg and e - start < 40 and len(new) < 64:
                            e += 1
                            if e in new:
                                break
                            new.add(e)
                    ends = new
                else:
                    ends = {e for e in ends if e >= size or not lattice[e] & arg}
                if not ends:
                    break
            else:
                yield start, min(ends) - 1


class Grammar:
    """The composed transducers: a text to its score and the scores of each kind."""

    def __init__(self) -> None:
        self.lexicon = Lexicon()
        self.clauses = Clauses(self.lexicon.bit)
        b = self.lexicon.bit
        self.neg, self.report, self.say = b["NEG"], b["REPORT"], b["SAY"]
        self.utterance, self.forbid = b["UTTERANCE"], b["FORBID"]
        self.offence = self.clauses.offence

    def sentences(self, text: str) -> Iterator[str]:
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text)) if not text.isascii() else text
        for line in _END.split(text):
            if line and not line.isspace():
                yield line.lower()

    def _join(self, m: re.Match) -> str:
        """Letters set apart as one word; a single letter before or behind them that is a word of its own stays one."""
        word = m[0].replace(m[1], "")
        if m[1] == " " and not self.lexicon.classes(word) and self.lexicon.classes(word[1:]):
            return f"{word[0]} {word[1:]}"
        if m[1] == " " and not self.lexicon.classes(word) and self.lexicon.classes(word[:-1]):
            return f"{word[:-1]} {word[-1]}"
        return word

    def score_sentence(self, s: str) -> dict[str, float]:
        if s.count(" ") + s.count(".") > 3:
            s = _APART.sub(self._join, s)
        spans = []
        for m in _TOKEN.finditer(s):
            cut = _CONTRACTED.search(m[0])
            # you're is two words, don't is one
            spans += [(m.start(), m.start() + cut.start()), (m.start() + cut.end(), m.end())] if cut else [(m.start(), m.end())]
        lattice = [self.lexicon.classes(s[a:z]) for a, z in spans]
        held = 0
        for m in lattice:
            held |= m
        if not held & self.offence:
            return {}
        if held & self.utterance and held & self.forbid and _listing(s):
            return {}
        quotes = [(m.start(), m.end()) for m in _QUOTED.finditer(s)] if held & (self.report | self.say) else []

        def counts(a: int, z: int, lifted: bool) -> bool:
            if lifted and any(m & self.neg for m in lattice[a + 1 : z]):
                return False
            i = bisect_right(quotes, spans[a][0], key=itemgetter(0)) - 1
            return i < 0 or spans[a][0] >= quotes[i][1]

        out: dict[str, float] = {}
        met: set[int] = set()
        for n, tag, weight, lifted, matches in self.clauses.run(lattice, held):
            if n not in met and any(counts(a, z, lifted) for a, z in matches):
                met.add(n)
                out[tag] = out.get(tag, 0.0) + weight
        return out

    def score(self, text: str | None) -> tuple[float, dict[str, float], int]:
        best, kinds, marked = 0.0, {}, 0
        for s in self.sentences(text or ""):
            got = self.score_sentence(s)
            if got:
                total = sum(got.values())
                marked += total >= MARK
                best = max(best, total)
                for k, v in got.items():
                    kinds[k] = max(kinds.get(k, 0.0), v)
        return best, kinds, marked


@lru_cache(maxsize=1)
def grammar() -> Grammar:
    return Grammar()


KINDS = ("insult", "threat", "sexual", "hate")


def _scorer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    g = grammar()
    for b in batches:
        rows = [g.score(t) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(2), pa.array([r[0] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.int32())]
            + [pa.array([r[1].get(k, 0.0) for r in rows], pa.float64()) for k in KINDS],
            names=["doc_id", "source", "score", "sentences", *KINDS],
        )


def normal_source(col):
    """One spelling for a source: lower case, trimmed, words joined by underscores; blank is null."""
    s = F.regexp_replace(F.lower(F.trim(col)), r"[\s\-]+", "_")
    return F.when(s != "", s)


def score_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, source, score, sentences, insult, threat, sexual, hate) for every row of ``docs`` (doc_id, text, source).

    A null or empty text scores 0. Repeated rows are scored each. The whole text is read, sentence by sentence.
    """
    return docs.select("doc_id", "text", normal_source(F.col("source")).alias("source")).mapInArrow(
        _scorer, "doc_id bigint, source string, score double, sentences int, " + ", ".join(f"{k} double" for k in KINDS)
    )


def rates(scored: DataFrame) -> DataFrame:
    """(source, documents, abusive, rate, insult, threat, sexual, hate): shares of documents at or above the mark."""
    hit = lambda c: F.sum((F.col(c) >= MARK).cast("int"))
    return (
        scored.groupBy("source")
        .agg(F.count(F.lit(1)).alias("documents"), hit("score").alias("abusive"), *[hit(k).alias(k) for k in KINDS])
        .withColumn("rate", F.round(F.col("abusive") / F.col("documents"), 6))
    )
