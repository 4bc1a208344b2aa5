"""Schema of annotated documents."""

from __future__ import annotations

SCHEMA_VERSION = "1.0"
EMOTIONS = ("happy", "angry", "sad", "fear", "surprise", "neutral", "unspecified")
INTENSITIES = ("low", "medium", "high", "unspecified")
SENTENCE_TYPES = ("declarative", "interrogative", "exclamative", "imperative", "incomplete")
REGISTERS = ("narrative", "conversational", "news", "formal", "technical")
PROVENANCES = ("user", "source", "rule", "lexicon", "predicted", "generated", "fallback")

TRACE = "stage string, operation string, original string, replacement string, start int, end int, provenance string, producer string, confidence double, sentence_index int"
TOKEN = (
    "text string, start int, end int, lemma string, upos string, xpos string, feats map<string,string>, head int, deprel string, is_interjection boolean, "
    "phonemes string, pronunciation_provenance string, pronunciation_producer string, pronunciation_confidence double, syllables array<string>, "
    "stressed_syllable_index int, stress_provenance string, stress_producer string, stress_confidence double, focus_score double, is_focus boolean, "
    "focus_provenance string, focus_producer string, focus_rules array<string>, pause_before_ms int, pause_after_ms int, local_relative_pitch double, "
    "local_relative_energy double, prosody_provenance string, prosody_producer string, prosody_rules array<string>"
)
EMOTION = "label string, confidence double, valence double, arousal double, intensity string, secondary_label string, distribution map<string,double>, evidence array<struct<span:string,rule:string>>, provenance string, producer string"
CONTEXT = "label string, confidence double, valence double, arousal double, intensity string, changed boolean, reason string, producer string"
PROSODY = "speaking_rate double, relative_pitch double, relative_energy double, terminal_contour string, pause_after_ms int, rules array<string>, provenance string, producer string"
SUGGESTION = "text string, position int, reason string, confidence double, matched_emotion string"


def struct(ddl: str) -> str:
    """``a string, b int`` as ``struct<a:string,b:int>``."""
    return "struct<" + ",".join(_fields(ddl)) + ">"


def _fields(ddl: str) -> list[str]:
    out, depth, cur = [], 0, ""
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(cur)
            cur = ""
        else:
            cur += c
    return [":".join(x.strip().split(" ", 1)) for x in [*out, cur]]


SENTENCE = (
    f"text string, start int, end int, normalized string, sentence_type string, is_negated boolean, emotion {struct(EMOTION)}, context_emotion {struct(CONTEXT)}, "
    f"prosody {struct(PROSODY)}, tokens array<{struct(TOKEN)}>, interjection_suggestions array<{struct(SUGGESTION)}>, text_with_interjections string"
)
