"""Fixed values that must equal the published model/data settings.

FIXED VALUES (do not change; results depend on them):
  special symbols (in dictionary order): bos 0, pad 1, eos 2, unk 3; nspecial 4
  special symbol strings: "<s>", "<pad>", "</s>", "<unk>"
  chunk length 30 s, minimum clip length 1 s
  max_source_positions 650, max_target_positions 975
  codec_depth 8, codec_dim 1024
  source vocabulary 10000 symbols, target vocabulary 8192 symbols (= depth * dim)
  max_tokens per batch 6500, required batch size multiple 1
  loader batch 16, loader workers 8, encoder micro-batch 128
  manifest split seed 42, valid fraction 0
  label smoothing 0.1
  semantic store name "xlsr2_unit", codec store name "meta24khz_{bw}kpbs_codec"
  codec bandwidth (kbps) -> codebooks: 1.5 -> 2, 3 -> 4, 6 -> 8, 12 -> 16, 24 -> 32
  semantic frame rate 50 Hz, acoustic frame rate 75 Hz
  pad_to_multiple 2 with pad value 1; layer-norm epsilon 1e-5
"""

BOS = 0
PAD = 1
EOS = 2
UNK = 3
NSPECIAL = 4
SPECIAL_SYMBOLS = ["<s>", "<pad>", "</s>", "<unk>"]

CHUNK_SECONDS = 30
MIN_SECONDS = 1

MAX_SOURCE_POSITIONS = 650
MAX_TARGET_POSITIONS = 975

CODEC_DEPTH = 8
CODEC_DIM = 1024
SOURCE_VOCAB = 10000
TARGET_VOCAB = 8192

MAX_TOKENS = 6500
BATCH_MULTIPLE = 1

LOADER_BATCH = 16
LOADER_WORKERS = 8
ENCODER_MICRO_BATCH = 128

SPLIT_SEED = 42
VALID_PERCENT = 0.0

LABEL_SMOOTHING = 0.1

SEMANTIC_STORE = "xlsr2_unit"
CODEC_STORE = "meta24khz_{bw}kpbs_codec"

BANDWIDTH_CODEBOOKS = {1.5: 2, 3.0: 4, 6.0: 8, 12.0: 16, 24.0: 32}

SEMANTIC_HZ = 50
ACOUSTIC_HZ = 75

PAD_MULTIPLE = 2
PAD_VALUE = 1
LAYER_NORM_EPS = 1e-5

# length of the source dictionary including specials; acoustic rows of the
# interleaved LM input are shifted by this amount
SOURCE_DICT_LEN = SOURCE_VOCAB + NSPECIAL
