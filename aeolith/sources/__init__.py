"""Tables in and out: catalog, scans, composition of files, writers and storage layout."""
