"""Reading corpora, histories and journals, and writing what comes of them."""
