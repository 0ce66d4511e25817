"""Column functions: paths, links, Markdown, front matter, field blocks, small texts."""
