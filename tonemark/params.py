"""Fixed values of the fingerprint format and of matching. Results only agree with other implementations if these do."""

# audio
SAMPLE_RATE, WINDOW, FFT_SIZE, HOP = 11025, 1024, 2048, 153
DT = 0.0138776  # seconds of a frame
K_MIN, K_MAX = 18, 575  # spectrum bins in use
QT, QF = 5.0, 9.0  # frames and bins of a quantised unit
SUPPRESS_T, SUPPRESS_F = 14, 31
AROUND_T, AROUND_F = 10, 18
CELL_T, CELL_F, STRIDE_T, STRIDE_F, NEXT_T, NEXT_F = 1, 3, 1, 3, 1, 3
CELLS_T, CELLS_F, BITS = 18, 10, 720
BYTES = BITS // 8
LEAST_BLOCK, MAX_RECORDING = 0.5, 1800
INDEX_SECONDS, QUERY_SECONDS = 60, 2.5

# vocabulary and terms
WORDS, MAX_ERROR = 100, 255
CHANNELS = 62
BAND, PAIRS, PAIR_FRAMES, PAIR_T, PAIR_F = 186, 10, 73, 15, 21
W1_SHIFT, B_SHIFT, W2_SHIFT, VPT_SHIFT = 19, 17, 10, 6

# matching
BATCH, BIN, TOP_K, MIN_SCORE, MAX_SCORE = 20, 365, 20, 2000, 1000
TIES = {"MSCALE": 11, "XSCALE": 10}
AROUND_GRAPH, PEAK_RADIUS = 15, 3
MAX_ID_TIME = 20.0

# postings layout
BLOCK_BYTES, CHUNK_BYTES = 32768, 6553

MATCH_TYPES = ("MSCALE", "XSCALE")
ID_TYPES = ("FUZZY", "BINARY")
ID_MODES = ("EASY", "STRICT")
CLASSES = ("UNIDENTIFIED", "SOUNDS_LIKE", "IDENTIFIED", "LISTENING")
STATUS = ("PENDING", "NO_MATCH", "MATCH")

#: Cut points of the memberships: low and short fall, medium rises and falls, high and long rise.
FUZZY = {
    "EASY": {"low": (0.55, 0.65), "med": (0.60, 0.70, 0.80), "high": (0.75, 0.90), "short": (1.5, 3.0), "mid": (2.0, 10.0, 22.0), "long": (17.5, 20.0)},
    "STRICT": {"low": (0.55, 0.65), "med": (0.60, 0.70, 0.92), "high": (0.875, 0.95), "short": (2.0, 5.0), "mid": (2.8, 12.0, 19.2), "long": (15.0, 20.0)},
}
