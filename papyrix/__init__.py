"""Text retrieval and corpus analytics as DataFrame operators."""
