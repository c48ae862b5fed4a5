"""Training-data operators: packing, WARC, near-duplicates, quality, HTML, decontamination, secrets, toxicity, licences."""
