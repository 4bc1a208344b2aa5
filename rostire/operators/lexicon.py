"""Word lists of the layers: fixed values of the annotation rules, and small lists of our own."""

from __future__ import annotations

# Spoken forms of abbreviations.
ABBREVIATIONS = {
    "dr": "doctor", "prof": "profesor", "ing": "inginer", "d-na": "doamna", "d-nul": "domnul", "nr": "numărul", "art": "articolul",
    "pag": "pagina", "str": "strada", "bd": "bulevardul", "sec": "secolul", "etc": "etcetera", "ex": "exemplu", "cf": "conform",
    "vol": "volumul", "cap": "capitolul", "fig": "figura",
}
# Counted nouns, as (singular, plural, gender).
CURRENCIES = {
    "lei": ("leu", "lei", "masculine"), "ron": ("leu", "lei", "masculine"), "€": ("euro", "euro", "masculine"),
    "eur": ("euro", "euro", "masculine"), "$": ("dolar", "dolari", "masculine"), "usd": ("dolar", "dolari", "masculine"),
}
UNITS = {
    "kg": ("kilogram", "kilograme", "neuter"), "g": ("gram", "grame", "neuter"), "mg": ("miligram", "miligrame", "neuter"),
    "t": ("tonă", "tone", "feminine"), "km": ("kilometru", "kilometri", "masculine"), "m": ("metru", "metri", "masculine"),
    "cm": ("centimetru", "centimetri", "masculine"), "mm": ("milimetru", "milimetri", "masculine"), "l": ("litru", "litri", "masculine"),
    "ml": ("mililitru", "mililitri", "masculine"), "h": ("oră", "ore", "feminine"), "min": ("minut", "minute", "neuter"),
    "s": ("secundă", "secunde", "feminine"),
}
# Intensifiers with their weights, discourse markers, formal markers.
INTENSIFIERS = {
    "extrem de": 1.8, "incredibil de": 1.8, "atât de": 1.6, "foarte": 1.6, "absolut": 1.5, "total": 1.5, "foarte tare": 1.5,
    "teribil de": 1.7, "tare": 1.4, "complet": 1.4, "super": 1.4, "mult": 1.3, "chiar": 1.3,
}
DISCOURSE = {"contrast": ["dar", "însă", "totuși", "ci"], "consequence": ["deci", "așadar", "prin urmare", "astfel"]}
FORMAL_MARKERS = [
    "astfel", "conform", "potrivit", "cu excepția", "condițiile legii", "articolul", "alineatul", "prezenta", "prezentei", "subsemnatul",
    "se va determina", "se stabilește", "dispune", "stipulează", "hotărăște", "în conformitate cu", "prevederile",
]
# Interjections in their order, with label and weight.
INTERJECTIONS = [
    ("uau", "surprise", 1.0), ("oau", "surprise", 1.0), ("vai", "surprise", 0.5), ("bravo", "happy", 1.0), ("super", "happy", 0.8), ("ura", "happy", 1.0),
    ("haha", "happy", 0.9), ("of", "sad", 0.7), ("aoleu", "fear", 0.8), ("ah", "surprise", 0.4), ("oh", "surprise", 0.4),
]
# The phoneme inventory, and pronunciations that override all else.
INVENTORY = ["ˈ", "ˌ", "ʲ", "a", "ə", "e", "i", "ɨ", "o", "u", "ɔ", "ɪ", "ʊ", "y", "b", "d", "f", "ɡ", "h", "j", "k", "l", "m", "n", "p", "r", "ɾ", "s", "ʃ", "t", "v", "w", "z", "ʒ", "ŋ", "ç"]
PRONUNCIATIONS = {"tva": "tˈe vˈe ˈa"}
# Raw classifier labels and the labels they count for; (valence, arousal) of each label.
RAW_LABELS = {
    "joy": "happy", "gratitude": "happy", "love": "happy", "anger": "angry", "frustration": "angry", "contempt": "angry",
    "disgust": "angry", "sadness": "sad", "fear": "fear", "surprise": "surprise", "neutral": "neutral",
}
LABELS = ["happy", "angry", "sad", "fear", "surprise", "neutral"]
PROTOTYPES = {"happy": (0.85, 0.65), "angry": (0.15, 0.80), "sad": (0.15, 0.30), "fear": (0.20, 0.75), "surprise": (0.60, 0.75), "neutral": (0.50, 0.40)}

# Our own small lists: closed-class words, negation, persons, and the default predictor's cues.
CLOSED_CLASS = {
    "ADP": "de la în din pe cu fără sub peste prin spre către pentru după între lângă până despre contra dintre dinspre",
    "DET": "un o niște acest această acești aceste acel acea fiecare orice al a ai ale",
    "CCONJ": "și sau ori dar iar însă ci nici deci",
    "SCONJ": "că să dacă deși fiindcă deoarece când cum precum ca",
    "AUX": "am ai are avem aveți au sunt ești este e suntem sunteți eram era erau voi vei va vom veți vor aș fi fost",
    "PART": "nu n-",
    "PRON": "eu tu el ea noi ei ele mă te îl ne vă îi le se își mie ție lui cine ce care nimeni nimic",
    "ADV": "foarte tare mult chiar absolut total complet super aici acolo acum atunci mâine azi ieri niciodată mai prea tot",
}
NEGATIONS = "nu n- niciodată nimic nimeni nici".split()
PERSONS = {"1": "eu noi mă ne mie am suntem avem eram voi vom", "2": "tu voi te vă ție ești ai aveți sunteți vei veți"}
IMPERATIVES = "vino stai pleacă ascultă spune lasă adu mută urcă coboară verifică încearcă întreabă caută vezi oprește rămâi sună așteaptă iartă-mă întoarce".split()
CUES = {
    "happy": "fericit fericită bucuros bucuroasă bravo ura minunat minunată super haha noroc zâmbitor zâmbitoare",
    "angry": "furios furioasă supărat supărată rușine enervat enervată nervos",
    "sad": "trist tristă dor păcat of plâns singur singură pierdut",
    "fear": "frică speriat speriată aoleu spaimă teamă necaz",
    "surprise": "uau oau vai uimit uimită minune incredibil ia",
}
