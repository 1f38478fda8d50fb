"""Thresholds, weights, labels and phrases that decide the results."""

MODALITIES = ["typing", "voice", "motor", "visual", "sleep"]
QUALITY_TRACKED = ["typing", "voice", "motor", "visual"]

MIN_QUALITY = 0.50
DISAGREE_CV = 0.35
DISAGREE_IQR_REL = 0.40
DISAGREE_RANGE_REL = 0.50

MIN_BASELINE_DAYS = 14
EWMA_ALPHA = 0.1
OUTLIER_MAD = 3.0
STD_TO_MAD = 0.6745
MAD_TO_STD = 1.4826
MIN_DISPERSION = 0.001
DISPERSION_EPSILON = 1e-6
EXTREME_Z = 10.0

SUSTAINED_Z = 2.0
SUSTAINED_DAYS = 5
SLOPE_THRESHOLD = 0.01

LABEL_WITHIN = "Within personal baseline"
LABEL_MILD = "Mild deviation from baseline"
LABEL_MODERATE = "Moderate deviation from baseline"
LABEL_SIGNIFICANT = "Significant deviation from baseline"
LABEL_SUSTAINED = "Sustained deviation detected"

TREND_PROGRESSIVE = "Progressive deviation from personal baseline"
TREND_STABLE = "Stable within baseline"
TREND_IMPROVING = "Improving toward baseline"

# Features rolled up per modality and day, each with the column names it may arrive under.
MODALITY_FEATURES = {
    "typing": {
        "typing_speed": ["typing_speed", "typing_speed_cpm", "speed"],
        "interval_variability": [
            "interval_variability",
            "std_inter_key_interval",
            "rhythm_variability",
            "iki_cv_pct",
        ],
        "correction_rate": ["correction_rate", "error_correction_rate"],
    },
    "voice": {
        "jitter": ["jitter"],
        "shimmer": ["shimmer"],
        "hnr": ["hnr"],
        "pitch_mean": ["pitch_mean"],
    },
    "motor": {
        "cadence": ["cadence"],
        "stride_variability": [
            "stride_variability",
            "stride_interval_variability",
            "stride_interval_cv_pct",
        ],
        "tapping_rate": ["tapping_rate"],
        "tremor_frequency": ["tremor_frequency", "tremor_freq_dominant_hz"],
    },
    "visual": {
        "blink_rate": ["blink_rate"],
        "gaze_stability": ["gaze_stability"],
        "reaction_time": ["reaction_time", "reaction_time_mean", "saccade_latency_mean_ms"],
    },
    "sleep": {
        "sleep_duration": ["sleep_duration"],
        "sleep_quality": ["sleep_quality"],
        "score": ["score"],
    },
}

# Features watched for disagreement between the sessions of one day, with their report names.
DISAGREEMENT_NAMES = {
    "typing_speed": "typing_speed",
    "interval_variability": "interval_variability",
    "jitter": "voice_jitter",
    "shimmer": "voice_shimmer",
    "cadence": "motor_cadence",
    "tapping_rate": "motor_tapping_rate",
    "tremor_frequency": "motor_tremor_frequency",
    "blink_rate": "visual_blink_rate",
    "gaze_stability": "visual_gaze_stability",
    "reaction_time": "visual_reaction_time",
}

# Statements that generated text must never contain.
FORBIDDEN_STATEMENTS = [
    "parkinson's detected",
    "parkinsons detected",
    "disease progression",
    "clinical deterioration",
    "you have parkinson's",
    "confirmed parkinson",
    "parkinson's progression",
    "disease worsening",
    "clinical decline",
]
VECTOR_FORBIDDEN_STATEMENTS = [
    "parkinson's detected",
    "you have parkinson's",
    "diagnosed parkinson",
    "confirmed parkinson",
    "parkinson's progression",
]

UUID_PATTERN = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
DATE_PATTERN = r"^\d{4}-\d{2}-\d{2}$"
FEATURE_VERSION = "1.0"
