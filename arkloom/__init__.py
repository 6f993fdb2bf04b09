"""Jobs over web-archive captures and page content, and operators for training corpora."""
