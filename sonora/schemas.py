"""Schemas of the engine's tables, and the decode configuration."""

from __future__ import annotations

from dataclasses import dataclass

# As DDL: readers and Arrow functions take it as it is.
WORD = "struct<word:string,start:double,end:double,prob:double>"
SPAN = "struct<start:double,end:double>"

UTTERANCES = "utt_id long, samples array<float>, sample_rate int, reference string, meta map<string,string>"
SEGMENTS = f"utt_id long, seg_id int, start double, end double, text string, avg_logprob double, no_speech_prob double, words array<{WORD}>"
SPANS = "utt_id long, start double, end double"
VOTES = "utt_id long, chunk int, lang string, p double"
SCORED = "condition string, seq long, score double, correct boolean"
POLICIES = "condition string, n_fit long, knots array<struct<x:double,y:double>>, threshold double, target_risk double, coverage double, realized_risk double, notes string"


@dataclass(frozen=True)
class DecodeConfig:
    """Knobs of a decode; providers read them, the confidence gate reads low_confidence and word_timestamps."""

    beam_size: int = 5
    temperature: tuple[float, ...] = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)
    compression_ratio_threshold: float = 2.4
    log_prob_threshold: float = -1.0
    no_speech_threshold: float = 0.6
    condition_on_previous_text: bool = False
    vad_filter: bool = True
    vad_min_silence_ms: int = 300
    word_timestamps: bool = False
    initial_prompt: str | None = None
    low_confidence: float = 0.85
