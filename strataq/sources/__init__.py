"""Readers of tables, file trees and manifests."""
