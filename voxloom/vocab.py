"""Token vocabulary and run-size constants.

FIXED VALUES — these must equal the values the training data was built with,
so they are stated plainly and in one place.
"""

# --- fixed values: special token ids -------------------------------------
START_OF_TEXT = 128000
END_OF_TEXT = 128009
BASE = 128256                      # first id after the text vocabulary
START_OF_AUDIO = BASE + 1          # 128257
END_OF_AUDIO = BASE + 2            # 128258
START_OF_HUMAN = BASE + 3          # 128259
END_OF_HUMAN = BASE + 4            # 128260
START_OF_GPT = BASE + 5            # 128261
END_OF_GPT = BASE + 6              # 128262
PAD = BASE + 7                     # 128263, also the speaker placeholder
PLACEHOLDER = PAD
START_OF_SPEAKER = BASE + 8        # 128264
END_OF_SPEAKER = BASE + 9          # 128265
AUDIO_OFFSET = BASE + 10           # 128266 (large model)
AUDIO_OFFSET_SMALL = 49162         # small model
CODEBOOK_SIZE = 4096               # codes per stream
SLOTS_PER_FRAME = 7                # 1 + 2 + 4 codes per frame
IGNORE_LABEL = -100                # ignored label, also the alternative placeholder

# --- fixed values: run sizes ---------------------------------------------
PACK_LIMIT = 8192                  # packed row token limit
MAX_LEN_PLAIN = 2048               # truncation of plain training rows
MAX_LEN_COLLATE = 4096             # truncation in the batch collator
MAX_LEN_PACKED = 8192              # truncation of packed speaker rows
SPEAKER_DIM = 192                  # speaker embedding width
PROJECTION_DIM = 3072              # projected embedding width
SHUFFLE_SEED = 42
HEAD_SAMPLE = 10000                # rows in the mean-length sample
BATCH_ROWS = 1000                  # contiguous batch size of the bulk encoder
OUTER_SHARDS = 10
INNER_SHARDS = 50
MAX_SHARD_INDEX = 1139             # shards 0..1139 of the bulk corpus
TARGET_SR = 24000                  # codec sample rate
EMBED_SR = 16000                   # speaker-embedding sample rate

# Prompt pieces (fixed values).
PLAIN_HEAD = [START_OF_HUMAN]
PLAIN_MIDDLE = [END_OF_TEXT, END_OF_HUMAN, START_OF_GPT, START_OF_AUDIO]
SPEAKER_MIDDLE_1 = [END_OF_TEXT, END_OF_HUMAN, START_OF_SPEAKER]
SPEAKER_MIDDLE_2 = [END_OF_SPEAKER, START_OF_GPT, START_OF_AUDIO]
TAIL = [END_OF_AUDIO, END_OF_GPT]

# Video-id pattern for the accepted URL forms (fixed value).
VIDEO_ID_PATTERN = r"(?:youtu\.be/|youtube\.com/(?:watch\?.*v=|shorts/))([^?&\"'>]+)"

# Shard file name: zero-padded index (fixed value).
SHARD_PATH_FORMAT = "EN/EN-B%06d.tar"

# Characters Python's str.strip() removes (fixed value), as a regex class.
PY_WHITESPACE_CLASS = (
    r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
