"""inkscan: content analytics over tables of text, documents, images and code, on Spark."""
