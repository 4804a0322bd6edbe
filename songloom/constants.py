"""Fixed values.

Every value below has to be exactly this for results to agree with the service
this library serves; they are data, not logic.
"""

# Corpus cleaning
MIN_YEAR = 1800
KEPT_LANGUAGES = ["en", "es"]
EXPECTED_CHUNKS = [1, 2, 3, 4]

# Genre labels shown to users -> tags stored in the corpus
GENRE_LABELS = {
    "Pop": "pop",
    "Rap": "rap",
    "R&B": "rb",
    "Rock": "rock",
    "Country": "country",
}

# Popularity multiplier: 1 + slope * (log10(max(views, 1)) - centre), at least floor
POPULARITY_SLOPE = 0.1
POPULARITY_CENTRE = 3.0
POPULARITY_FLOOR = 0.1

# Blend of vector score and 0-100 relevance score
VECTOR_WEIGHT = 0.7
RELEVANCE_WEIGHT = 0.3
NEUTRAL_RELEVANCE = 50
MIN_RELEVANCE = 50
RERANK_DEPTH = 100

# Search depths
TOP_K_SEARCH_ALL = 8
TOP_K_SEARCH_CHUNKS = 7
TOP_K_RAW = 10
TOP_K_SERVICE = 50
TOP_K_JOB = 25
TOP_K_CLI = 7
OVERFETCH_ALL = 3
OVERFETCH_CANDIDATES = 2

# "Vectors look normalised already" rule
UNIT_NORM_ROWS = 512
UNIT_NORM_LOW = 0.98
UNIT_NORM_HIGH = 1.02

# Playlist picking
PLAYLIST_MIN_TRACKS = 5
PLAYLIST_MAX_TRACKS = 100
PLAYLIST_MAX_SONGS = 30

# Phrases used when no search phrase could be read
FALLBACK_PHRASES = [
    "chill vibes",
    "emotional songs",
    "mood music",
    "life experiences",
    "feelings playlist",
]
N_PHRASES = 5

# Passages and training pairs
PASSAGE_MERGE_BELOW = 200
PASSAGE_MAX_CHARS = 800
QUERY_SEED_WORDS = 20
QUERY_TEMPLATES = [
    "I'm going through: {}",
    "This sounds like: {}",
    "I feel like: {}",
    "Relates to: {}",
    "A story about: {}",
]
MIN_SONGS_PER_CHUNK = 100
SAMPLES_PER_EPOCH = 200_000

# Lyrics sent for scoring, and text left over in scraped lyrics
LYRICS_MAX_CHARS = 5000
LYRICS_FOOTER = "EmbedShare URLCopyEmbedCopy"

# Result presentation defaults
DEFAULT_ALBUM = "Unknown Album"
DEFAULT_GENRE = "Unknown Genre"
DEFAULT_DURATION_MS = 180000
VARIOUS_GENRES = "Various Genres"
MISSING_URL = "None"

# View-count histogram
VIEW_EDGES = [0, 100, 1_000, 10_000, 100_000, 500_000, 1_000_000, 2_000_000, 5_000_000, 10_000_000]
VIEW_CAP = 10_000_000
VIEW_BINS = 10

# Job states and the messages that go with the final ones
FINAL_STATES = ["completed", "failed", "cancelled"]
COMPLETED_MESSAGE = "Playlist created successfully!"
FAILED_MESSAGE = "Failed to create playlist"
CANCELLED_MESSAGE = "Job cancelled by user"

# File names of the positional corpus layout
VECTOR_FILE_PATTERN = r"embeddings_chunk_(\d+)(?:\.from_(\d+))?\.npy"
LYRICS_FILE_PATTERN = r"song_lyrics_chunk_(\d+)\.csv"
METADATA_FILE_PATTERN = r"other_columns_chunk_(\d+)\.csv"
