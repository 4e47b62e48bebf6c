"""Reading source trees and index tables, and writing them."""
