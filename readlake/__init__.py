"""readlake: Spark jobs over readable content (pages, documents, chats, frames)."""
