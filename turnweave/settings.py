"""Settings of the conversation analysis; every value is a literal of the plans that are built from them."""

from __future__ import annotations

from dataclasses import dataclass, replace

#: Frames are 10 ms; signals are analysed at 16 kHz.
FRAME_SEC, TARGET_SR = 0.01, 16_000
OVERLAP, SILENCE = -2, -1


@dataclass(frozen=True)
class Settings:
    # speakers
    num_speakers: int | None = None
    min_speakers: int = 2
    max_speakers: int = 3
    # activity
    vad_min_speech_sec: float = 0.25
    vad_min_silence_sec: float = 0.20
    energy_vad_threshold_db: float = 30.0
    # windows
    window_sec: float = 1.5
    hop_sec: float = 0.75
    min_window_sec: float = 1.0
    min_segment_sec: float = 0.40
    boundary_fade_ms: float = 8.0
    # simultaneous speech
    remove_overlap: bool = True
    overlap_margin: float = 0.15
    overlap_mode: str = "separate"
    overlap_assign_margin: float = 0.10
    separation_backend: str = "separation"
    sep_chunk_sec: float = 8.0
    # cross-talk
    crosstalk_gate: bool = True
    crosstalk_win: float = 0.6
    crosstalk_hop: float = 0.3
    crosstalk_keep_margin: float = 0.03
    crosstalk_self_floor: float = 0.55
    crosstalk_min_rms: float = 0.004
    crosstalk_second_speaker: bool = False
    crosstalk_second_factor: float = 2.5
    overlap_dilate_sec: float = 0.0
    boundary_guard_sec: float = 0.0
    # cleaning and tracks
    denoise: bool = True
    denoise_backend: str = "spectral"
    denoise_strict: bool = False
    denoise_chunk_sec: float = 300.0
    denoise_strength: float = 0.85
    enhance: bool = True
    highpass_hz: float = 80.0
    presence_db: float = 3.0
    presence_hz: float = 4000.0
    air_db: float = 1.5
    air_hz: float = 8_000.0
    compress: bool = True
    compressor_threshold_db: float = -22.0
    compressor_ratio: float = 3.0
    target_lufs: float = -16.0
    ceiling_db: float = -1.0
    # back ends
    diarization_backend: str = "builtin"
    vad_backend: str = "energy"
    vad_strict: bool = False
    embedding_backend: str = "mfcc"
    # output
    export_per_speaker: bool = True
    export_compact: bool = True

    def speaker_range(self) -> range:
        if self.num_speakers is not None:
            return range(self.num_speakers, self.num_speakers + 1)
        return range(max(1, self.min_speakers), max(self.min_speakers, self.max_speakers) + 1)


#: How much is cut around simultaneous speech: margin, gate, keep margin, self floor.
PRESETS: dict[str, dict] = {
    "off": {"remove_overlap": False, "overlap_margin": 0.15, "crosstalk_gate": False, "crosstalk_keep_margin": 0.03, "crosstalk_self_floor": 0.55},
    "light": {"overlap_margin": 0.08, "crosstalk_keep_margin": 0.0, "crosstalk_self_floor": 0.45},
    "medium": {"overlap_margin": 0.15, "crosstalk_keep_margin": 0.03, "crosstalk_self_floor": 0.55},
    "strong": {"overlap_margin": 0.25, "crosstalk_keep_margin": 0.07, "crosstalk_self_floor": 0.62},
    "extreme": {"overlap_margin": 0.35, "crosstalk_keep_margin": 0.12, "crosstalk_self_floor": 0.70},
    "max": {"overlap_margin": 0.45, "crosstalk_keep_margin": 0.16, "crosstalk_self_floor": 0.78, "overlap_dilate_sec": 0.30, "boundary_guard_sec": 0.25, "crosstalk_second_speaker": True, "crosstalk_second_factor": 1.5},
}


def preset(level: str, base: Settings | None = None) -> Settings:
    if level not in PRESETS:
        raise ValueError(f"unknown level {level!r}; one of {', '.join(PRESETS)}")
    return replace(base or Settings(), **PRESETS[level])
